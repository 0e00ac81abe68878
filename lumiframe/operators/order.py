"""Exact order statistics of all values of a relation, without one task or buffer that holds them.

Ranks are found by narrowing: sketches of the values between two bounds give three guesses, a pass counts what lies below each, and
the bounds move to the guesses on either side of the rank. What is left at the end is at most ``most`` rows, or one value.
Nulls don't count; NaN sorts after every number, as in Spark. Each function runs its passes when it is called.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.functions import kernels
from lumiframe.operators.graph import _checkpoint

#: Rows that the driver may hold at the end of a search.
MOST = 100_000
#: Sketch size: a guess is off by at most one rank in this many.
ACCURACY = 10_000

_FINITE = "v is not null and not isnan(v) and abs(v) < double('Infinity')"


def _between(v: DataFrame, lo: float, hi: float) -> DataFrame:
    return v.filter((F.col("v") >= lo) & (F.col("v") <= hi))


def _value_at(v: DataFrame, rank: int, lo: float, hi: float, n: int, below: int, most: int) -> float:
    """The value at ``rank`` (from 0) of numbers; ``n`` of them lie in [lo, hi] and ``below`` under it."""
    while lo < hi:
        inside = _between(v, lo, hi)
        if n <= most:
            rows = inside.groupBy("v").count().orderBy("v").collect()
            return float(rows[int(np.searchsorted(np.cumsum([r["count"] for r in rows]), rank - below, side="right"))]["v"])
        q, eps = (rank - below + 0.5) / n, 2.0 / ACCURACY
        guesses = inside.agg(F.percentile_approx("v", [max(0.0, q - eps), q, min(1.0, q + eps)], ACCURACY).alias("g")).first()["g"]
        a, m, b = (float(g) for g in guesses)
        x = F.col("v")
        count = lambda c: F.count(F.when(c, 1))
        r = inside.agg(
            count(x < a).alias("under_a"), count(x < m).alias("under_m"), count(x <= m).alias("to_m"), count(x <= b).alias("to_b"),
            F.max(F.when(x < m, x)).alias("before_m"), F.min(F.when(x > m, x)).alias("after_m"),
        ).first()
        k = rank - below
        if r["under_m"] <= k < r["to_m"]:
            return m
        if k < r["under_m"]:
            up = r["under_m"]
            start = r["under_a"] if r["under_a"] <= k else 0
            lo, hi = a if start else lo, float(r["before_m"])
        else:
            up, start = (r["to_b"] if k < r["to_b"] else n), r["to_m"]
            lo, hi = float(r["after_m"]), b if up < n else hi
        n, below = up - start, below + start
    return lo


def quantile(df: DataFrame, q: float = 0.5, most: int = MOST) -> float | None:
    """The exact quantile of ``v``, interpolated between neighbouring ranks; None without values."""
    v = df.select(F.col("v").cast("double").alias("v")).filter("v is not null")
    known = ~F.isnan("v")
    s = v.agg(F.count("v").alias("all"), F.count(F.when(known, 1)).alias("n"), F.min(F.when(known, F.col("v"))).alias("lo"), F.max(F.when(known, F.col("v"))).alias("hi")).first()
    if not s["all"]:
        return None
    at = q * (s["all"] - 1)
    first, last = math.floor(at), math.ceil(at)
    if last >= s["n"]:
        return float("nan")
    v = v.filter(known)
    low = _value_at(v, first, s["lo"], s["hi"], s["n"], 0, most)
    if first == last:
        return low
    r = v.agg(F.count(F.when(F.col("v") <= low, 1)).alias("to"), F.min(F.when(F.col("v") > low, F.col("v"))).alias("next")).first()
    high = low if last < r["to"] else float(r["next"])
    return low if low == high else low * (last - at) + high * (at - first)


def ranked(df: DataFrame) -> DataFrame:
    """(i, v): the finite numbers of ``v`` with their places from 0. One range shuffle, equal values dealt by a hash of their row, and a written table;
    places are the counts of the parts before plus the place in the part."""
    salted = df.select(F.col("v").cast("double").alias("v"), F.xxhash64(*df.columns).alias("h")).filter(_FINITE)
    held = _checkpoint(salted.orderBy("v", "h").select("v", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))
    sizes = sorted((r["part"], r["count"]) for r in held.groupBy("part").count().collect())
    begins = np.cumsum([0, *[n for _, n in sizes]])
    table = df.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, begins, strict=False)], "part int, begin bigint")
    return held.join(F.broadcast(table), "part").select((F.col("begin") + F.col("k")).alias("i"), "v")


def half_sample_mode(df: DataFrame, most: int = MOST) -> float | None:
    """The half-sample mode of all finite numbers of ``v``: of sorted values the narrowest half is kept, the first of equal ones, until few
    are left; the half that ends at the last value takes no part, as in ``kernels.half_sample_mode``.

    A half's width joins each place with the place half a sample on. Once ``most`` rows are left they are finished at once."""
    v = df.filter(_FINITE)
    n = v.count()
    if not n:
        return None
    if n > most:
        s, begin = ranked(df), 0
        while n > most:
            half = -(-n // 2)
            own = s.filter((F.col("i") >= begin) & (F.col("i") < begin + n - half))
            far = s.filter((F.col("i") >= begin + half - 1) & (F.col("i") < begin + n)).select((F.col("i") - (half - 1)).alias("i"), F.col("v").alias("far"))
            begin = own.join(far, "i").agg(F.min(F.struct((F.col("far") - F.col("v")).alias("w"), "i")).alias("m")).first()["m"]["i"]
            n = half
        v = s.filter((F.col("i") >= begin) & (F.col("i") < begin + n))
    return float(kernels.half_sample_mode(np.sort(np.array([r["v"] for r in v.select("v").collect()], float))))
