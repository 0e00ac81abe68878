"""Spelling variants: keys, pairs and roots against every pair of words, and the query against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lumiframe.llm import spelling as S

DOCS = "doc_id long, text string"


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow(docs, damaged=S.DAMAGED):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damaged and h % damaged == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out, form = [], {}
    for w in words:
        others = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        if others and words[others[0]] >= 5 * words[w]:
            form[w] = others[0]
        out.append((w, form.get(w), None, words[w], len(others), words[form[w]] if w in form else None))
    last = {}
    for w in words:
        r = w
        while r in form:
            r = form[r]
        last[w] = r
    return sorted((w, f, last[w], *rest) for w, f, _, *rest in out)


def made(seed, n=300):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé\u00ff\u00d7", k=rng.randint(5, 9))) for _ in range(25)]
    words = []
    for w in base:
        for k, c in ((0, 300), (1, 40), (2, 8), (3, 5)):
            x = list(w)
            for _ in range(k):
                p = rng.randrange(len(x))
                x[p : p + rng.randint(0, 1)] = rng.choice(["", "z", "E", "é"])
            words += ["".join(x)] * c
    rng.shuffle(words)
    return [(k if k % 17 else None, " ".join(words[k::n]) + rng.choice(["", ".", " 12 ĀÉ_ab"])) for k in range(n)]


def test_keys_are_those_of_the_deletions():
    words = ["abcdef", "aabbcc", "abcde", "abcdeg", "é" * 7, "éxéxéx", "a", "x" * 2000]
    plain = {k: {words[k]} | {words[k][:i] + words[k][i + 1 :] for i in range(len(words[k]))} for k in range(len(words))}
    got = {}
    for key, at in S.keys_of(words):
        for x, k in zip(key.tolist(), at.tolist(), strict=True):
            got.setdefault(k, []).append(x)
    assert all(len(got[k]) == len(set(got[k])) == len(plain[k]) for k in plain)
    for a in plain:
        for b in plain:
            assert len(set(got[a]) & set(got[b])) == len(plain[a] & plain[b])


@pytest.mark.parametrize(("seed", "damaged"), [(1, 199), (2, 3), (3, None)])
def test_variants_against_every_pair(spark, seed, damaged):
    docs = made(seed)
    got = S.variants(S.vocabulary(spark.createDataFrame(docs, DOCS).repartition(3), damaged=damaged))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == slow(docs, damaged)


def test_a_chain_of_forms(spark):
    chain = [("abcdefgh"[:6] + "x" * k, 6**k * 5) for k in range(5)]
    df = spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate(chain)], "id long, word string, n long")
    assert {r.word: r.root for r in S.variants(df).collect()} == dict.fromkeys((w for w, _ in chain), chain[-1][0])


def test_edges(spark, monkeypatch):
    """Nulls, empty texts, repeated rows, a very long word, tiny task tables, clashing columns, an empty table."""
    monkeypatch.setattr(S, "HELD", 1)
    long = "ab" * 60_000
    rows = [(1, None, 1), (2, "", 1), (None, None, 1)] + [(None, "Strasse straSse strasse strasses", 2)] * 5 + [(9, long, 3)] * 5 + [(10, long + "a", 3)] * 25
    df = spark.createDataFrame(rows, "doc_id long, text string, word int").withColumnRenamed("word", "n")
    got = {r.word: r for r in S.variants(S.vocabulary(df)).collect()}
    assert (got["strasse"].n, got["strasse"].form, got["strasses"].form, got["strasses"].n_near) == (15, None, None, 1)
    assert got[long].form == got[long].root == long + "a" and got[long].form_n == 25
    assert S.variants(S.vocabulary(df.limit(0))).count() == 0


def test_query_against_sql(spark, tmp_path):
    spark.createDataFrame(made(7), DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(S.oracle_sql()).fetchall(), key=lambda r: r[0])
    got = S.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want == slow(made(7))
