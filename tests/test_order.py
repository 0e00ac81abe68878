"""Global order statistics against numpy, with limits so small that every step is taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe.functions import kernels
from lumiframe.operators import normalize, order

RNG = np.random.default_rng(5)
CASES = {
    "normal": RNG.normal(size=4001),
    "even": RNG.gamma(0.3, size=3000),
    "ties": np.repeat([1.0, 2.0, 7.0], [900, 900, 300]),
    "two": np.repeat([-1.0, 4.0], 1000),
    "hot": np.concatenate([np.zeros(1500), RNG.normal(size=1500)]),
    "constant": np.full(700, 3.5),
    "far": np.concatenate([RNG.normal(size=999) * 1e-9, [1e300, -1e300]]),
}


def frame(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double").repartition(5)


@pytest.mark.parametrize("name", CASES)
def test_quantiles_and_mode(spark, name):
    v = CASES[name]
    df = frame(spark, v).cache()
    for q in (0.0, 0.08, 0.5, 1.0):
        assert np.isclose(order.quantile(df, q, most=40), np.quantile(v, q), rtol=1e-12, atol=1e-15), q
    assert np.isclose(order.half_sample_mode(df, most=40), kernels.half_sample_mode(v), rtol=1e-12)


def test_ranks_are_whole(spark):
    got = order.ranked(frame(spark, CASES["hot"])).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(3000)) and np.array_equal([r["v"] for r in got], np.sort(CASES["hot"]))


def test_nothing_and_what_is_no_number(spark):
    none = spark.createDataFrame([(0, None)], "k int, v double")
    assert order.quantile(none) is None and order.half_sample_mode(none) is None
    assert normalize.robust_std(none).first()["v"] is None
    mixed = frame(spark, [1, 2, 3, float("nan")])
    assert order.quantile(mixed) == 2.5 and np.isnan(order.quantile(mixed, 1.0))
    assert mixed.agg(F.percentile("v", F.lit(0.5))).first()[0] == 2.5
