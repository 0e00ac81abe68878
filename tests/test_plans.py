"""The number of shuffles of the headline plans, and that none has a Cartesian product."""

import re

import pytest

from lumiframe.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "shuffles"), [("p1_mean_emb", 1), ("p7_local_correlation_emb", 1), ("p12_binned_max", 1), ("l1_ljung_box", 1), ("q1_gaussian_time", 1), ("q1_gaussian_space", 2), ("q2_median_space", 1), ("n5_normalize_median_max_pp", 2)])
def test_shuffles(spark, name, shuffles):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(re.findall(r"\bExchange\b", plan)) == shuffles
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["p1_mean_emb", "p7_local_correlation_emb", "m9_region_traces"])
def test_scans_read_only_what_they_need(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", plan)
    assert schemas and all("embedding" in s or "label" in s for s in schemas)
    if "label" not in name and name != "m9_region_traces":
        assert not any("label" in s for s in schemas)
