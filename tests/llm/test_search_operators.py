"""Decontamination, HTML, nearest neighbours, secrets, pipeline: against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe.llm import ann, decontaminate, html_extract, secret_scan
from lumiframe.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def _edits(a, b, free):
    p = [0] * (len(b) + 1) if free else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return min(p) if free else p[-1]


def test_edit_search_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        d, s, e = decontaminate.best_span(a, b)
        assert d == min(_edits(a, b, True), len(a)) == _edits(a, b[s:e], False)


def test_decontamination_recall_and_clean_documents(spark):
    rng = random.Random(2)
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = [f"{' '.join(f'w{rng.randrange(5000)}' for _ in range(200))}" for _ in range(30)]
    docs, want = [(k, t) for k, t in enumerate(clean)], set()
    for n, (i, t) in enumerate(bench):
        w = t.split()
        for _ in range(int(0.1 * len(w))):
            w[rng.randrange(len(w))] = "zzz"
        host = clean[n % 30].split()
        at = rng.randrange(len(host))
        docs.append((1000 + n, " ".join(host[:at] + w + host[at:])))
        want.add((1000 + n, i))
    docs += [(5000, None), (5001, ""), (5002, bench[0][1].upper()), (None, bench[1][1])]
    df = spark.createDataFrame(docs, DOCS)
    b = table(spark, SF, "benchmark")
    got = decontaminate.matches(df, b).toPandas()
    pairs = set(zip(got.doc_id.fillna(-1).astype(int), got.item_id, strict=True))
    assert len(want & pairs) >= 0.97 * len(want)
    assert not got[got.doc_id < 1000].shape[0] and (got.similarity >= 0.8).all()
    assert (5002, bench[0][0]) in pairs and (-1, bench[1][0]) in pairs
    left = {r.doc_id for r in decontaminate.clean(df, b).collect()}
    assert set(range(30)) <= left and 5000 in left and 5002 not in left
    assert decontaminate.matches(df.limit(0), b).count() == 0 == decontaminate.matches(df, b.limit(0)).count()


def test_decontamination_finds_all_at_the_allowed_edits():
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    for n in (*range(5, 65), 80, 130, 300):  # edits are substitutions, insertions and deletions, with words known and unknown
        items = [(k, " ".join(word() for _ in range(n))) for k in range(12)]
        texts = []
        for _, t in items:
            w = t.split()
            for _ in range(decontaminate.edits_allowed(n)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            texts.append(" ".join([*[word() for _ in range(rng.randint(0, 40))], *w, *[word() for _ in range(20)]]))
        got = {(t, k) for t, k, *_ in decontaminate.Index.of(items).search(texts)}
        assert {(k, k) for k in range(12)} <= got, n


def test_decontamination_of_short_items_and_scripts_without_spaces():
    items = [(0, "alpha beta"), (1, "\u4eca\u5929\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u5427"), (2, "one two three four"), (3, "...")]
    texts = ["x Alpha, beta y", "beta alpha", "\u4ed6\u8bf4\u4eca\u5929\u5929\u6c14\u5f88\u574f\u6211\u4eec\u53bb\u516c\u56ed\u5427\u3002", "one two three five", None, "one two three four"]
    got = decontaminate.Index.of(items).search(texts)
    assert {(t, k) for t, k, *_ in got} == {(0, 0), (2, 1), (5, 2)}
    assert {(t, s, n, d) for t, _, s, n, d in got} == {(0, 1, 2, 0), (2, 2, 12, 1), (5, 0, 4, 0)}


def test_decontamination_in_several_passes(spark):
    df = table(spark, SF, "documents")
    b = table(spark, SF, "benchmark")
    one = {tuple(r) for r in decontaminate.matches(df, b).collect()}
    assert {tuple(r) for r in decontaminate.matches(df, b, items_per_pass=7).collect()} == one
    key = lambda r: (r.doc_id, r.text)
    assert sorted(decontaminate.clean(df, b, items_per_pass=7).collect(), key=key) == sorted(decontaminate.clean(df, b).collect(), key=key)
    assert decontaminate.clean(df.withColumn("__gone", F.lit(1)), b, items_per_pass=7).columns == [*df.columns, "__gone"]


def test_decontamination_against_every_pair(spark):
    """Every document against every item, by the edit distance of the item to the best span of the whole document."""
    docs = [(r.doc_id, decontaminate.words_of(r.text)) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in table(spark, SF, "benchmark").collect()]
    want = {(d, i) for d, t in docs for i, w in items if len(set(w) & set(t)) > 0.5 * len(set(w)) and decontaminate.edit_search(w, t)[0] <= decontaminate.edits_allowed(len(w))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()}
    assert got == want and want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
<div class="ad">Buy</div>{body}<div class="comments">bad</div><footer>&copy; x</footer></body></html>"""


def test_html_marks():
    lines = lambda h: html_extract.lines_of(h)
    page = PAGE.format(body="<article><h1>A &amp; B</h1><p>one <b>two</b>three<br>four</p><form>f</form></article><p>out</p>")
    assert lines(page) == (["A & B", "one twothree", "four", "out"], [True, True, True, False])
    assert lines(None) == lines("") == ([], [])
    assert lines("<p>cut &am")[0] == ["cut &am"] and lines("<p>a<foot")[0] == ["a"] and lines("a < b")[0] == ["a < b"]
    assert lines("<!-- x --><p>y<!-- open")[0] == ["y"]


def test_html_omitted_end_tags():
    lines = lambda h: html_extract.lines_of(h)[0]
    assert lines('<p class="notice">Hi<p>Body</p><p>more') == ["Body", "more"]
    assert lines('<ul><li class="menu">Home<li>One<li>Two</ul><p>Body') == ["One", "Two", "Body"]
    assert lines('<ul><li class="menu">Home<ul><li>sub</ul></ul><p>Body') == ["Body"]
    for left_out in ("nav", "aside", "form"):
        assert lines(f"<body><{left_out}>Home<article><p>Body</article></body>") == ["Body"]
        assert lines(f"<div><{left_out}>Home</div><p>Body") == ["Body"]
    assert lines('<div class="comments"><article>reply</article></div><p>Body') == ["Body"]
    assert lines('<table><tr><td class="ad">Buy<td>Cell<tr><td>Next</table>') == ["Cell", "Next"]


def test_html_lcs():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
        sub = [x for x, k in zip(a, html_extract.lcs_mask(a, b), strict=True) if k]
        it = iter(b)
        assert len(sub) == table_[-1][-1] and all(x in it for x in sub)


def test_html_differencing(spark):
    page = lambda n: f"<body><p>Site slogan</p><p>text of {n}</p><p>All rights reserved</p></body>"
    rows = [(1, "http://h/a/1", page(1)), (2, "http://h/a/2?x=1", page(2)), (3, "http://h/b/1", page(3)), (4, "http://h/b/1", page(3)), (5, "http://lone/", page(5)), (6, None, None), (7, "odd", "<p>z</p>"), (8, "http://h/a/9", "<main><p>Site slogan</p></main><p>text of 1</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).coalesce(1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    slogan, rights = "Site slogan ", " All rights reserved"
    assert got[1] == "text of 1" and got[2] == "text of 2" and got[8] == "Site slogan text of 1"  # protected, and not shared
    assert got[5] == f"{slogan}text of 5{rights}" and got[6] == "" and got[7] == "z"
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 8, 13, 211])
def test_html_partners_across_copies_and_partitions(spark, n):
    """A host that starts with copies, and more partitions than pages: every page has its nearest distinct partner, with and without an article."""
    page = lambda n: f"<body><p>Site slogan</p><p>text of {n}</p><p>All rights reserved</p></body>"
    marked = lambda n: f"<body><p>Site slogan</p><article><p>Same start</p><p>text of {n}</p></article><p>All rights reserved</p></body>"
    rows = [(k, f"http://h/a/{k}", page(0)) for k in range(6)] + [(k, f"http://h/b/{k}", page(k)) for k in range(6, 12)] + [(20, "http://lone/", page(20)), (21, "http://m/0", "<main><p>same</p></main>"), (22, "http://m/1", "<p>same</p>")]
    rows += [(k, f"http://n/{k}", marked(k)) for k in range(30, 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {k: f"text of {0 if k < 6 else k}" for k in range(12)} | {20: "Site slogan text of 20 All rights reserved", 21: "same", 22: "same"}
    want |= {k: f"Same start text of {k}" for k in range(30, 40)}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_html_very_long_and_null_pages(spark):
    long = "<p>head</p>" + "".join(f"<p>line {k}</p>" for k in range(20_000)) + "<p>" + "x" * 1_000_000 + "</p>"
    rows = [(1, "http://h/1", long), (2, "http://h/2", "<p>head</p><p>own</p>"), (None, "http://h/3", None), (4, None, "<p>lost"), (2, "http://h/2", "<p>head</p><p>own</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("lines", F.lit("clash"))
    got = sorted(((r.page_id or 0, r.text) for r in html_extract.extract(df).collect()), key=lambda r: (r[0], len(r[1])))
    assert [(k, t) for k, t in got if k != 1] == [(0, ""), (2, "own"), (2, "own"), (4, "lost")]
    assert got[1][1].startswith("line 0 line 1 ") and len(got[1][1]) > 1_000_000


def test_html_on_the_table(spark):
    import html

    for r in html_extract.extract(table(spark, SF, "pages")).join(table(spark, SF, "pages"), ["page_id", "url"]).collect():
        body = r.html.split("<article>", 1)[1].split("</article>")[0]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)


def _nearest(ids, x, queries, k=5):
    out = []
    n = np.sqrt((x**2).sum(1))
    for q in queries:
        s = (x @ x[q]) / (n * n[q])
        c = sorted((-round(float(v), 12), int(i)) for v, i, own in zip(s, ids, ids == ids[q], strict=True) if not own)
        out.append([i for _, i in c[:k]])
    return out


def test_ann_against_brute_force(spark):
    from lumiframe.llm.queries import queries

    got = queries()["op7_ann"](spark, SF).toPandas()
    rows = table(spark, SF, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    qs = [k for k, i in enumerate(ids) if i % 50 == 0]
    want = _nearest(ids, x, qs)
    mine = [got[got.query_id == ids[q]].sort_values("rank").vec_id.tolist() for q in qs]
    hits = sum(len(set(a) & set(b)) for a, b in zip(mine, want, strict=True))
    assert hits >= 0.99 * 5 * len(qs)


def test_ann_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=6)
    rows = [(k, [float(v) for v in (hot if k % 3 else rng.normal(size=6))]) for k in range(1, 400)]
    near = [(1000 + k, [float(v) for v in hot + rng.normal(size=6) * 1e-3]) for k in range(300)]
    bad = [(0, None), (50, [0.0] * 6), (100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (150, [float("nan")] * 6), (200, [1.0]), (2000, [float("inf")] * 6), (None, [1.0] * 6)]
    rows = [r for r in rows if r[0] not in (50, 100, 150, 200)] + near
    df = spark.createDataFrame([(*r, "c") for r in [*rows, *bad]], "vec_id long, embedding array<double>, score string").repartition(3)
    got = ann.search(df, df.filter("vec_id % 50 = 0")).toPandas()
    good = sorted(rows)
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good])
    qs = [k for k, i in enumerate(ids) if i % 50 == 0]
    assert sorted(set(got.query_id)) == ids[qs].tolist()
    want = _nearest(ids, x, qs)
    assert [got[got.query_id == ids[q]].sort_values("rank").vec_id.tolist() for q in qs] == want
    again = ann.search(df, df.filter("vec_id % 50 = 0"), queries_per_pass=3).toPandas()
    key = ["query_id", "rank"]
    assert again.sort_values(key).reset_index(drop=True).equals(got.sort_values(key).reset_index(drop=True))
    few = df.filter("vec_id in (250, 1, 2)")
    assert sorted(ann.search(few, few.filter("vec_id = 250")).toPandas()["rank"]) == [1, 2]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_of_several_lengths(spark):
    rows = [(k, [1.0, float(k)]) for k in range(6)] + [(k, [1.0, float(k), 2.0]) for k in range(50, 56)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id in (0, 50)"), k=2).collect()
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(0, 1): 1, (0, 2): 2, (50, 1): 51, (50, 2): 52}


@pytest.mark.parametrize("clusters", [0, 40])
def test_ann_scores_few_pairs_exactly(clusters):
    """The codes prune: at most one pair in twenty is scored exactly, without losing a neighbour."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 64))
    if clusters:
        x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(x))] + 0.5 * x
    ids, unit = np.arange(len(x)), x / np.sqrt((x**2).sum(1))[:, None]
    model = ann.fit_books(unit[:4000])
    qs = ids[::200]
    s = ann.Searcher(model, qs, x[qs], 5)
    for c in range(0, len(x), 8192):
        codes, rho, perp = model.encode(unit[c : c + 8192])
        s.add(ids[c : c + 8192], x[c : c + 8192], ann.packed(codes), rho, perp)
    assert [r.tolist() for r in s.best.id] == _nearest(ids, x, qs)
    assert s.scored < 0.05 * s.pairs, s.scored / s.pairs


# secrets
BASE = {
    "assign": (re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def slow_spans(text):
    return sorted(((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE.values()) for m in p.finditer(text or "") if ok(m)), key=lambda s: s[:2])


SECRETS = ["secret=token: abcdefgh", "token = abc password=secret123", "Api_Key: 'AAAAAA=='", "AKIAAKIA" + "A" * 14, "AKIA" + "B" * 15, "x" + "0a" * 12 + "g" + "f" * 23, "é👍 apikey=" + "a1" * 20 + " 👍 AKIA" + "Z9" * 10, "token=abcdef", "passwd==x==y", "-----BEGIN RSA PRIVATE KEY-----", " ".join(f"token={k:06d}" for k in range(500))]


def _digests(df):
    return {r.doc_id: r for r in secret_scan.digest(secret_scan.to_paths(df.select("doc_id", "text"), secret_scan.scan_unseen(df))).collect()}


def test_secret_spans_against_python(spark):
    docs = [(k, t) for k, t in enumerate([*SECRETS, None, "", SECRETS[0]])] + [(99, "word " * 50_000 + SECRETS[1])]
    df = spark.createDataFrame([(*d, "clash") for d in docs], DOCS + ", spans string")
    got = _digests(df)
    kinds = list(BASE)
    for d, t in docs:
        want = slow_spans(t)
        text = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3)), (d, t and t[:60])
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x.split(":")[0] in kinds) == text
    assert secret_scan.scan_unseen(df.limit(0)).count() == 0
    assert "spans_0" in secret_scan.to_paths(df, secret_scan.scan_unseen(df)).columns


def test_ledger_scans_unseen_pairs_only(spark):
    a = spark.createDataFrame([(1, "v1", SECRETS[2]), (1, "v2", SECRETS[1]), (2, "v1", SECRETS[2])], "doc_id long, version string, text string")
    first = secret_scan.scan_unseen(a)
    assert first.count() == 2  # two contents
    ledger = secret_scan.ledger_rows(first)
    assert ledger.count() == 2 * len(secret_scan.RULES)
    assert secret_scan.scan_unseen(a, ledger).count() == 0
    more = a.union(spark.createDataFrame([(3, "v1", SECRETS[7])], a.schema))
    assert secret_scan.scan_unseen(more, ledger).count() == 1
    import dataclasses

    newer = (dataclasses.replace(secret_scan.RULES[0], version=2), *secret_scan.RULES[1:])
    again = secret_scan.scan_unseen(a, ledger, rules=newer).collect()
    assert [r.rule_ids for r in again] == [["assign@2"]] * 2
    full = {r.blob_id: r.spans for r in first.collect()}
    back = {r.blob_id: r.spans for r in secret_scan.from_ledger(ledger).collect()}
    assert full == back
    assert secret_scan.to_paths(a, first).filter(F.size("spans") > 0).count() == 3


def test_ledger_on_disk(spark, tmp_path):
    """Three runs over one ledger: new blobs, nothing new, a newer rule. Findings always are those of a scan of everything."""
    import dataclasses

    path = str(tmp_path / "ledger")
    a = spark.createDataFrame([(1, SECRETS[2]), (2, SECRETS[1]), (3, SECRETS[2]), (4, None)], DOCS)
    b = a.union(spark.createDataFrame([(5, SECRETS[7]), (6, "clean")], DOCS))
    newer = (dataclasses.replace(secret_scan.RULES[0], version=2), *secret_scan.RULES[1:])
    n = []
    for df, rules in ((a, secret_scan.RULES), (b, secret_scan.RULES), (b, secret_scan.RULES), (b, newer)):
        got = {r.blob_id: r.spans for r in secret_scan.findings(df, path, rules=rules).collect()}
        want = {r.blob_id: r.spans for r in secret_scan.scan_unseen(b, rules=rules).collect() if r.spans}
        assert got == {k: v for k, v in want.items() if k in got} and (df is a or got == want)
        n.append(spark.read.parquet(path).count())
    kinds = len(secret_scan.RULES)
    assert n == [3 * kinds, 5 * kinds, 5 * kinds, 5 * kinds + 5]


def test_hot_blob_and_clashing_columns(spark):
    rows = [(k, "x token=abcdefgh y" if k % 3 == 0 else f"clean {k}", "q") for k in range(300)]
    df = spark.createDataFrame(rows, DOCS + ", __blob string").withColumn("__found", F.lit(1)).withColumn("__spans", F.lit(2)).withColumn("__masked", F.lit(3)).withColumn("__text", F.lit(4)).withColumn("blob_id", F.lit(5)).withColumn("spans", F.lit(6))
    from lumiframe.llm.stages import mask_secrets

    got = mask_secrets(spark, df, SF)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {k: t.replace("token=abcdefgh", "[SECRET]") for k, t, _ in rows}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdefgh x AKIA" + "A" * 20 + "."), (2, None), (3, "clean")], DOCS)
    v = secret_scan.to_paths(df, secret_scan.scan_unseen(df))
    got = {r.doc_id: r.t for r in v.select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é [SECRET] x [SECRET].", 2: None, 3: "clean"}


def test_secret_scan_plan_is_native(spark):
    from lumiframe.llm.queries import queries

    plan = queries()["op10_secret_scan"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    seen = [docs.columns]
    from lumiframe.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        seen.append(docs.columns)
    assert all(c == seen[0] for c in seen)
    ids = {r.doc_id for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == ids
    assert docs.filter("n_chars <> char_length(text)").count() == 0
    assert secret_scan.scan_unseen(docs).filter(F.size("spans") > 0).count() == 0


def test_secrets_are_masked_in_the_stage(spark):
    from lumiframe.llm.stages import mask_secrets

    df = spark.createDataFrame([(1, "a token=abcdefgh b", 18), (2, "clean", 5), (3, None, 0)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in mask_secrets(spark, df, SF).collect()}
    assert got == {1: ("a [SECRET] b", 12), 2: ("clean", 5), 3: (None, 0)}


def test_stages_take_empty_tables_and_clashing_columns(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents").withColumn("score", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("component_id", F.lit("c"))
    for frame in (docs.limit(0), docs.limit(20)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, frame, SF)
            assert got.columns == frame.columns
            got.collect()


def test_stage_masks_whole_private_keys(spark):
    from lumiframe.llm import stages

    key = "\n".join("Ab+/" * 16 for _ in range(30)) + "\nAbc9="
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = [f"a\n{begin}\nDEK-Info: AES-128-CBC,00\n\n{key}\n{end}\nb", f"a {begin}\n{key}\nb c", f"x {begin} y {begin}\n{key}\n{end} z", f"q {begin}"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.text for r in stages.mask_secrets(spark, df, SF).collect()}
    assert got == {0: "a\n[SECRET]\nb", 1: "a [SECRET]\nb c", 2: "x [SECRET] y [SECRET] z", 3: "q [SECRET]"}
