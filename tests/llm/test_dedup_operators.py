"""Near-duplicates, substring dedup, components: against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lumiframe.llm import components, simhash, substring_dedup
from lumiframe.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def _roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def slow_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[k : k + 4]), seed=42).intdigest() for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "  ", "One", "one two", "A b C d", "á É x y z", "rep rep rep rep rep rep", "w" * 3000 + " x y z q"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    from pyspark.sql import functions as F

    t = "only four words here"
    import xxhash

    assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(t.encode(), 42)


@pytest.mark.parametrize("most", [2, 128])
def test_links_against_all_pairs(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
    chain = rng.getrandbits(64)
    for k in range(10):  # a chain whose ends are far apart
        fps.add(chain)
        chain ^= 0b1111 << (4 * k)
    fps = sorted(fps)
    want = _roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    at = {int(np.uint64(f).view(np.int64)): k for k, f in enumerate(fps)}
    got = _roots(len(fps), [(at[r.a], at[r.b]) for r in simhash.links(df, most).collect()])
    assert got == want


def test_near_duplicates(spark):
    docs = table(spark, SF, "documents")
    got = simhash.near_duplicates(docs).toPandas()
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in docs.collect()]
    rows.sort()
    root = _roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4])
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == {rows[k][0]: rows[r][0] for k, r in enumerate(root)}


def test_deduplicate_edges(spark):
    t = "one two three four five six seven eight"
    rows = [(5, t, "x"), (2, t, "x"), (2, t, "x"), (9, None, "x"), (8, "", "y"), (None, t, "z"), (None, "quite another text of words", "z"), (None, "quite another text of words", "z")]
    docs = spark.createDataFrame(rows, DOCS + ", component_id string")
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in simhash.deduplicate(docs).collect())
    assert [(d, x) for _, d, x in got] == [(2, t), (8, ""), (None, "quite another text of words")]
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def _clashing(spark):
    """Two texts under one id, alone and with a copy of one of them elsewhere; a repeated row; rows without an id."""
    a, b = "one two three four five six seven eight", "quite another text that nobody has copied so far"
    alone = spark.createDataFrame([(7, a, 1), (7, b, 2)], DOCS + ", __gone_id int")
    copied = spark.createDataFrame([(7, a, 1), (7, b, 2), (3, a, 3), (7, b, 2), (None, b, 4)], DOCS + ", __gone_id int")
    return (a, b), alone, copied


@pytest.mark.parametrize("which", ["simhash", "stage"])
def test_texts_under_one_id_are_kept_apart(spark, which):
    from lumiframe.llm import stages

    (a, b), alone, copied = _clashing(spark)
    run = simhash.deduplicate if which == "simhash" else lambda d: stages.drop_near_duplicates(spark, d, SF)
    assert sorted((r.doc_id, r.text) for r in run(alone).collect()) == [(7, a), (7, b)]
    assert sorted((r.doc_id, r.text) for r in run(copied).collect()) == [(3, a), (7, b)]
    assert run(copied).columns == copied.columns


def test_one_hot_group_is_salted_and_broadcast(spark):
    """A third of the rows equal, and a component of many near copies."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base)) for k in range(400)] + [(1000 + k, " ".join([*base[:k], "zz", *base[k + 1 :]])) for k in range(100)] + [(5000 + k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(600)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).toPandas()
    fps = {d: simhash.fingerprint(t) for d, t in rows}
    uniq = sorted(set(fps.values()))
    root = _roots(len(uniq), [(i, j) for i in range(len(uniq)) for j in range(i) if (uniq[i] ^ uniq[j]).bit_count() <= 4])
    of = dict(zip(uniq, root, strict=True))
    least = {}
    for d, f in fps.items():
        least[of[f]] = min(least.get(of[f], d), d)
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == {d: least[of[f]] for d, f in fps.items()}


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 560)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, **{k: 500 for k in range(501, 560)}}
    assert components.components(edges.limit(0)).count() == 0


def test_rounds_meet_forests_of_dense_parts(spark, monkeypatch):
    """A part of all pairs enters the rounds with at most one edge a node from each task, also where a task gives out several buffers."""
    n, met = 300, []
    state = components._state
    monkeypatch.setattr(components, "_state", lambda e: met.append(state(e)[0]) or state(e))
    edges = spark.range(n * n).selectExpr("id div 300 a", "id % 300 b").filter("a < b").selectExpr("a", "b", "a = 0 bare").repartition(4)
    for buffer in (components.BUFFER, 1000, 100):
        monkeypatch.setattr(components, "BUFFER", buffer)
        met.clear()
        got = {r.node: r.root for r in components.components(edges).collect()}
        assert got == {k: 0 for k in range(1, n)}
        assert met[0] <= (4 * n if buffer >= 1000 else n * n // 2)
    words = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in components.components(words).collect()} == {("b", "a"), ("c", "a"), ("y", "x")}


def slow_substring_dedup(docs, window=13):
    first = {}
    for d, t in docs:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = (t or "").encode().split()
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def _got(df, **kw):
    return [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.deduplicate(df, **kw).collect()]


@pytest.mark.parametrize("most", [substring_dedup.MOST_HOLDERS, 20, 0])
def test_substring_dedup_against_brute_force(spark, most):
    """By shards alone, with the windows of hot keys one by one, and with all windows so. Document 205 has more windows of one key than a segment."""
    rng = random.Random(4)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(10, 60))] for _ in range(12)]
    docs = []
    for d in range(160):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))]
        docs.append((d, " ".join(words)))
    docs += [(200, None), (201, ""), (202, "too short"), (203, docs[5][1]), (203, docs[6][1]), (203, docs[6][1]), (None, docs[7][1]), (204, "é " * 40), (205, "é " * 20_000)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    key = lambda r: (r[0] is None, r)
    assert sorted(_got(df, most_holders=most), key=key) == sorted(slow_substring_dedup(docs), key=key)
    assert _got(df.limit(0), most_holders=most) == []


def test_hot_and_other_keys_share_one_pass_over_the_texts(spark, monkeypatch):
    """Texts go to their keys once, hot keys or not: no text of a hot key's windows is written or joined apart."""
    docs = [(k, " ".join([f"c{i}" for i in range(20)] + [f"w{k // 2}x{i}" for i in range(30)])) for k in range(60)]
    written, write = [], substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, label: written.append(label) or write(df, label))
    got = _got(spark.createDataFrame(docs, DOCS).repartition(4), most_holders=10)
    assert sorted(got) == sorted(slow_substring_dedup(docs))
    assert written == ["repeated-keys", "hot-keys", "spans"]


def test_a_hot_minimizer_fills_no_shard(spark):
    """A line that every document holds between words of its own: all its windows go one by one."""
    rng = random.Random(2)
    line = [f"line{k}" for k in range(8)]
    lone = lambda: [f"u{rng.randrange(10**9)}" for _ in range(15)]
    docs = [(k, " ".join([*lone(), *line, *lone()])) for k in range(300)] + [(1000, " ".join([f"x{k}" for k in range(5)] + line)), (1001, " ".join([f"x{k}" for k in range(5)] + line))]
    got = _got(spark.createDataFrame(docs, DOCS).repartition(4), most_holders=10)
    assert sorted(got) == sorted(slow_substring_dedup(docs)) and sum(r[2] for r in got) == 13


def test_automaton_finds_the_first_document():
    rng = random.Random(0)
    for _ in range(400):
        w = rng.randint(2, 4)
        docs = sorted((rng.randint(0, 5), [rng.choice("abc") for _ in range(rng.randint(w, 9))]) for _ in range(rng.randint(1, 6)))
        m, first = substring_dedup.Automaton(), {}
        for d, ws in docs:
            grams = [tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)]
            assert m.earliest(ws, w) == [first.get(g) for g in grams]
            m.add(ws, d)
            for g in grams:
                first.setdefault(g, d)


def test_regions_meet_as_often_as_they_should():
    """Sets meet in a tree's region with probability s ** LEVELS; copies always do, and strangers never."""
    from lumiframe.llm import forest

    rng = np.random.default_rng(3)
    of = lambda h: np.array(forest.regions(forest.signature(np.unique(h))))
    hit = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 60, np.uint64)
        b = np.concatenate((a[6:], rng.integers(0, 1 << 63, 6, np.uint64)))
        x, y = of(a), of(b)
        assert (x == y).any() and (x == of(a[::-1])).all()
        hit += (x == y).sum()
        assert not (x == of(rng.integers(0, 1 << 63, 60, np.uint64))).any()
    assert abs(hit / (300 * forest.TREES) - (54 / 66) ** forest.LEVELS) < 0.03


def _jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_stage_finds_every_pair_of_similarity_08(spark):
    """Texts whose fingerprints are up to 13 bits apart, against all pairs; also a group of near copies and a passage that many texts hold."""
    from lumiframe.llm import stages

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for k in range(25):
        base = [word() for _ in range(rng.randint(60, 200))] + (passage if k % 2 else [])
        for _ in range(4):
            w = base[:]
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(150)]
    texts += [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(0, 150, 3)]
    texts += ["", "a b", "a b", "a b c"]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (texts[i] and texts[j]) and _jaccard(texts[i], texts[j]) >= 0.8]
    assert any((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 4 for i, j in links)
    root = _roots(len(texts), links)
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    got = stages.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))
    edges = [(5, "q r s t u v"), (2, "q r s t u v"), (2, "q r s t u v"), (9, None), (8, ""), (None, "q r s t u v"), (None, "x y z"), (None, "x y z")]
    got = stages.drop_near_duplicates(spark, spark.createDataFrame(edges, DOCS), SF)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "x y z"), (2, "q r s t u v"), (8, "")]


def test_crowded_documents_are_compared_with_all_in_blocks():
    """Documents around one text, some of them linked already: what compare adds joins every pair of similarity 0.8, and no other."""
    from lumiframe.llm import forest

    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(60):
        w = base[:]
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{k}_{rng.random()}"
        texts.append(" ".join(w))
    texts += [" ".join(f"{k}y{j}" for j in range(30)) for k in range(3)] + ["one two"]
    sets = [forest.shingles(t, 5) for t in texts]
    known = [(k, k - 1) for k in range(1, len(texts), 2)]
    keys, label = np.arange(len(texts)), np.array([k // 2 for k in range(len(texts))])
    want = [(i, j) for j in range(len(texts)) for i in range(j) if _jaccard(texts[i], texts[j]) >= 0.8]
    got = forest.compare(keys, sets, label, np.zeros(len(texts), int))
    assert len(want) > 100 and all((min(p), max(p)) in set(want) and p[0] // 2 != p[1] // 2 for p in got)
    assert _roots(len(texts), got + known) == _roots(len(texts), want + known)
