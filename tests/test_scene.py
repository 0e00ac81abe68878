"""The scene that solver queries run on: its cells are found again, all of them by the plain factorisation, some by online detection."""

import numpy as np
from pyspark.sql import functions as F

from lumiframe.plans import extraction, registry

SF = "/root/testdata/sf0.001"


def cells(spark):
    return {(r["sy"], r["sx"]) for r in extraction.centres(spark, SF).collect()}


def test_extraction_finds_the_cells(spark):
    at = registry.queries()["f9_extract"](spark, SF).groupBy("roi").agg(*[(F.sum(F.col(k) * F.col("w")) / F.sum("w")).alias(k) for k in "yx"]).collect()
    for y, x in cells(spark):
        assert min(np.hypot(r["y"] - y, r["x"] - x) for r in at) < 2, (y, x)


def test_what_online_detection_finds_are_cells(spark):
    at = registry.queries()["f22_extract_online"](spark, SF).groupBy("roi").agg(*[(F.sum(F.col(k) * F.col("w")) / F.sum("w")).alias(k) for k in "yx"]).collect()
    assert at
    for r in at:
        assert min(np.hypot(r["y"] - y, r["x"] - x) for y, x in cells(spark)) < 1, r


def test_registration_undoes_the_moves(spark):
    r = registry.queries()["r16_assess"](spark, SF).first()
    assert r["after"] > r["before"] and r["after"] > 0.999


def test_time_courses_follow_the_activity(spark):
    tc = registry.queries()["z6_time_courses"](spark, SF)
    ce = extraction.centres(spark, SF).withColumnRenamed("seed", "roi")
    act = ce.join(extraction.activity(extraction.emb(spark, SF)), (F.col("y") == F.col("sy")) & (F.col("x") == F.col("sx"))).select("roi", "t", "a")
    rs = tc.join(act, ["roi", "t"]).groupBy("roi").agg(F.corr("tc", "a").alias("tc"), F.corr("tc_lsq", "a").alias("lsq")).collect()
    assert len(rs) == len(cells(spark)) and all(r["tc"] > 0.95 and r["lsq"] > 0.95 for r in rs)
