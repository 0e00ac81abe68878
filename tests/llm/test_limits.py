"""Bounds of what a task holds and of what is sent."""

import random

import pyarrow as pa

from lumiframe.llm import forest, stages
from lumiframe.session import BATCH_BYTES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest_batch(df):
    def sizes(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    return max(r.n for r in df.mapInArrow(sizes, "n long").collect())


def test_a_stage_bounds_the_batches_of_its_tasks(spark, tmp_path):
    docs = spark.range(4000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 700) AS text")
    had = spark.conf.get(KEY)
    try:
        spark.conf.unset(KEY)
        assert largest_batch(docs) > 3 * BATCH_BYTES
        stages.pack(spark, docs, str(tmp_path))
        assert largest_batch(docs) < 1.5 * BATCH_BYTES
        spark.conf.set(KEY, "1000000")
        stages.pack(spark, docs, str(tmp_path))
        assert spark.conf.get(KEY) == "1000000"
    finally:
        spark.conf.set(KEY, had)


def test_each_set_goes_once_to_a_small_group(spark, monkeypatch):
    """Groups that meet and larger ones, sent to hubs, find the same; a group's sets and pairs are all that meets."""
    rng = random.Random(4)
    sets = {k: sorted(rng.sample(range(60), 50)) for k in range(40)} | {100 + k: sorted(rng.sample(range(1000, 1014), 12)) for k in range(20)}
    rows = [(k, forest.np.array(h, forest.np.int64).tobytes()) for k, h in sets.items()]
    pairs = [(a, b) for a in sets for b in sets if a < b and (a < 100) == (b < 100)]
    want = {(a, b) for a, b in pairs for m in [len(set(sets[a]) & set(sets[b]))] if 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m)}
    full, sizes = spark.createDataFrame(rows, "key long, h binary"), spark.createDataFrame([(k, len(h)) for k, h in sets.items()], "key long, n int")
    tried = spark.createDataFrame(pairs, "a long, b long")
    assert want and len(want) < len(pairs)
    hubs = []
    by_hubs = forest._by_hubs
    monkeypatch.setattr(forest, "_by_hubs", lambda p, s, percent: hubs.append(p.count()) or by_hubs(p, s, percent))
    for most, sent in ((1 << 20, []), (8 * 12 * 20, [40 * 39 // 2]), (0, [len(pairs)])):
        hubs.clear()
        got = [tuple(r) for r in forest.confirmed(tried, full, sizes, 80, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want and hubs == sent
