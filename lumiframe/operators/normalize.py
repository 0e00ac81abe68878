"""Baselines, normalisation and value statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiframe.functions.kernels import MAD_TO_STD
from lumiframe.operators import order
from lumiframe.operators.movie import PLANE
from lumiframe.operators.projections import half_sample_mode

CENTRES = ("median", "mean", "min", "mode")
SCALES = ("median", "mean", "max", "robuststd")


def _one(df: DataFrame, v: float | None) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,)], "v double")


def robust_std(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., v): median absolute deviation over its normal-law factor. Two aggregates, joined on the keys; without keys both medians
    are searched for when this is called (``order.quantile``)."""
    if not keys:
        mid = order.quantile(df)
        off = None if mid is None else order.quantile(df.select(F.abs(F.col("v") - mid).alias("v")))
        return _one(df, None if off is None else off / MAD_TO_STD)
    mid = df.groupBy(*keys).agg(F.percentile("v", F.lit(0.5)).alias("__m"))
    both = df.join(mid, list(keys))
    return both.groupBy(*keys).agg((F.percentile(F.abs(F.col("v") - F.col("__m")), F.lit(0.5)) / MAD_TO_STD).alias("v"))


def robust_std_of_known(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``robust_std`` of the values that are numbers; groups without any have no row."""
    return robust_std(df.filter(F.col("v").isNotNull() & ~F.isnan("v")), keys)


def _baseline(movie: DataFrame, kind: str, keys: Sequence[str]) -> DataFrame:
    if kind == "robuststd":
        return robust_std(movie, keys)
    if not keys and kind in ("median", "mode"):
        return _one(movie, order.quantile(movie) if kind == "median" else order.half_sample_mode(movie))
    if kind == "mode":
        return movie.groupBy(*keys).agg(F.collect_list("v").alias("a")).select(*keys, half_sample_mode(F.col("a")).alias("v"))
    value: Column = {"median": F.percentile("v", F.lit(0.5)), "mean": F.avg("v"), "min": F.min("v"), "max": F.max("v")}[kind]
    return movie.groupBy(*keys).agg(value.alias("v"))


def baselines(movie: DataFrame, centre: str | None = "min", scale: str | None = "median", pixel_centre: bool = False, pixel_scale: bool = False, keys: Sequence[str] = PLANE) -> tuple[DataFrame, DataFrame]:
    """(centre, scale), each one row or one row a pixel. The scale is that of the movie as it is, before centring; a zero scale is 1."""
    if centre not in (*CENTRES, None) or scale not in (*SCALES, None):
        raise ValueError(f"centre must be one of {CENTRES}, scale one of {SCALES}")
    spark = movie.sparkSession
    c = _baseline(movie, centre, keys if pixel_centre else ()) if centre else spark.createDataFrame([(0.0,)], "v double")
    s = _baseline(movie, scale, keys if pixel_scale else ()) if scale else spark.createDataFrame([(1.0,)], "v double")
    return c.withColumnRenamed("v", "c"), s.withColumn("s", F.when(F.col("v") == 0, 1.0).otherwise(F.col("v"))).drop("v")


def apply_baselines(movie: DataFrame, centre: DataFrame, scale: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    """(v - c) / s; what isn't a number becomes zero, infinities the largest finite numbers."""
    m = movie
    for b in (centre, scale):
        m = m.join(b, list(keys)) if keys[0] in b.columns else m.crossJoin(F.broadcast(b))
    z = (F.col("v") - F.col("c")) / F.col("s")
    top = 1.7976931348623157e308
    z = F.when(z.isNull() | F.isnan(z), 0.0).when(z == float("inf"), top).when(z == float("-inf"), -top).otherwise(z)
    return m.select(*keys, "t", z.alias("v"))


def normalize(movie: DataFrame, centre: str | None = "min", scale: str | None = "median", pixel_centre: bool = False, pixel_scale: bool = False, keys: Sequence[str] = PLANE) -> DataFrame:
    return apply_baselines(movie, *baselines(movie, centre, scale, pixel_centre, pixel_scale, keys), keys)


def describe(centre: str | None, scale: str | None, pixel_centre: bool, pixel_scale: bool) -> str:
    """``(pixel-mode, all-median)``; ``[]`` if nothing is done."""
    parts = [f"{'pixel' if own else 'all'}-{kind}" for kind, own in ((centre, pixel_centre), (scale, pixel_scale)) if kind]
    return f"({', '.join(parts)})" if parts else "[]"


def summary(df: DataFrame) -> DataFrame:
    return df.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, lo, n) over equal widths; the last bin is closed; a constant gets the width-one range around it."""
    ends = df.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    put = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int")
    counts = df.select("v").crossJoin(F.broadcast(ends)).groupBy(put.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "b")
    return every.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def value_marks(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median and half-sample mode of each trace's values; without keys all values are one trace, whose
    median and mode are searched for when this is called."""
    if not keys:
        m = df.agg(F.avg("v").alias("mean"))
        return m.select("mean", F.lit(order.quantile(df)).cast("double").alias("median"), F.lit(order.half_sample_mode(df)).cast("double").alias("mode"))
    return df.groupBy(*keys).agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), half_sample_mode(F.collect_list("v")).alias("mode"))
