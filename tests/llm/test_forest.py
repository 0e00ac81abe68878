"""Near-duplicates by the LSH forest: against every pair, with and without large regions."""

import random

import duckdb
import numpy as np
import pytest

from lumiframe.llm import forest as L
from lumiframe.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def slow_set(text, k=4):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return [find(x) for x in range(n)]


def slow(rows):
    """{doc_id: (size, component)} of every pair's similarity."""
    sets = [(i, slow_set(t)) for i, t in sorted(rows)]
    links = [(k, j) for k, (_, x) in enumerate(sets) for j, (_, y) in enumerate(sets[:k]) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return {sets[k][0]: (len(sets[k][1]), sets[r][0]) for k, r in enumerate(roots(len(sets), links))}


def changed(rng, words, rate):
    return [w if rng.random() > rate else f"{w}{rng.randrange(1000)}" for w in words]


def groups(seed, sizes, length=120, rate=0.02):
    """Near copies of invented texts: each changed from the first, or from the one before."""
    rng, rows = random.Random(seed), []
    for g, n in enumerate(sizes):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for k in range(n):
            x = changed(rng, base, rate * (1 + k % 3))
            base = x if g % 2 and k % 9 == 0 else base
            rows.append(" ".join(x))
    rng.shuffle(rows)
    return list(enumerate(rows))


def ours(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in L.near_duplicates(df, **kw).collect()}


@pytest.mark.parametrize("most", [2, 64])
def test_groups_against_every_pair(spark, most, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_NODES", 40)
    rows = groups(most, [150, 90, 30, 4, 3, 2, 2, 1, 1])
    assert ours(spark.createDataFrame(rows, DOCS).repartition(4), most=most) == slow(rows)


def test_table_against_every_pair(spark):
    docs = table(spark, SF, "documents")
    assert ours(docs) == slow([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_compare_in_a_block(seed, two):
    rows = groups(seed, [60, 25, 1, 1])
    sets = [L.shingles(t) for _, t in rows]
    keys = np.array([i for i, _ in rows])
    side = keys % 2 if two else np.zeros(len(keys), int)
    got = L.compare(keys, sets, keys.copy(), side)
    want = [(a, b) for a in range(len(rows)) for b in range(a) if side[a] != side[b] or not two for m in [len(np.intersect1d(sets[a], sets[b]))] if 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m)]
    assert roots(len(rows), got) == roots(len(rows), want) and len(got) < len(rows)
    assert all(not two or side[a] != side[b] for a, b in got)


def test_letters_of_one_template(spark):
    """8,000 letters that are alike but never similar: few rows are dealt, and no pair is made for them."""
    rng = random.Random(3)
    base = [f"t{k}" for k in range(93)]
    rows = [(k, " ".join(base[:40] + [f"s{rng.randrange(100_000)}x{j}" for j in range(11)] + base[40:])) for k in range(8000)]
    df = spark.createDataFrame(rows, DOCS).repartition(8)
    sets = L.sketch(df)
    each = sets.groupBy("key").agg(L.F.first("n").alias("n"), L.F.first("regions").alias("r"))
    met = each.select("key", L.F.explode("r").alias("h"))
    big = met.join(met.groupBy("h").count().filter(f"count > {L.MOST}"), "h").select("h", "key")
    dealt = L.clusters(big, big.select("key", L.F.col("key").alias("label")).distinct(), each.select("key", "n"))
    assert dealt.count() <= L.SPREAD * each.count()
    assert L.links(sets, df).count() == 0


def test_edges(spark):
    """Nulls, empty, short, repeated, very long and null-id rows; columns with the names used inside; an empty table."""
    long = " ".join(f"x{k % 50_000}" for k in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (7, long), (8, long + " y"), (8, long + " y"), (9, "x" * 300_000), (None, "a b c d")]
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], DOCS + ", key int, sig binary").selectExpr("*", "key AS n", "key AS row")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in L.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 50_000, 7), (8, 50_001, 7), (8, 50_001, 7), (9, 1, 9), (None, 1, 6)], key=str)
    assert L.near_duplicates(df.limit(0)).count() == 0


def test_query_against_sql(spark, tmp_path):
    rows = groups(11, [40, 12, 3, 2, 1, 1]) + [(10_000, None), (10_001, ""), (10_002, "one two"), (10_003, "One two")]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(L.oracle_sql()).fetchall())
    assert sorted(map(tuple, L.op12_minhash_near_dedup(spark, str(tmp_path)).collect())) == want
