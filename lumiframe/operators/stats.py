"""Quality metrics: residual autocorrelation, motion metrics, correlations, spectra, peaks."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import kernels
from lumiframe.functions.columns import correlation, or_zero
from lumiframe.operators import projections
from lumiframe.operators.movie import PLANE, to_trace

Keys = Sequence[str]


def ljung_box(movie: DataFrame, skip: int = 0, lags: int | None = None, keys: Keys = PLANE) -> DataFrame:
    """(keys..., q, p, passed): the Ljung-Box test of each pixel; a constant pixel passes. One shuffle, then array functions; p in an Arrow batch."""
    a = to_trace(movie, keys)
    n = F.size("trace")
    top = F.lit(lags) if lags else F.greatest(F.lit(1), F.least(F.floor(10 * F.log10(n)).cast("int"), n - 1))
    mean = F.aggregate("trace", F.lit(0.0), lambda s, x: s + x) / n
    a = a.select(*keys, F.transform("trace", lambda x: x - mean).alias("z"), top.alias("m"))
    a = a.withColumn("e", F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x)).withColumn("n", F.size("z"))
    cov = lambda k: F.aggregate(F.zip_with(F.slice("z", k + 1, F.col("n") - k), F.slice("z", F.lit(1), F.col("n") - k), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = F.aggregate(F.sequence(F.lit(skip + 1), F.col("m")), F.lit(0.0), lambda s, k: s + F.pow(cov(k) / F.col("e"), 2) / (F.col("n") - k))
    a = a.withColumn("q", F.when((F.col("e") > 0) & (F.col("m") > skip), F.col("n") * (F.col("n") + 2) * q).otherwise(0.0))

    @F.pandas_udf("double")
    def tail(q: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([kernels.chi2_tail(x, k) for x, k in zip(q, df, strict=True)], dtype=float)

    return a.select(*keys, "q", tail("q", F.col("m") - skip).alias("p")).withColumn("passed", F.col("p") > 0.05)


def autocorrelation_failures(movie: DataFrame, skip: int = 0, keys: Keys = PLANE) -> DataFrame:
    return ljung_box(movie, skip, None, keys).agg(F.sum((~F.col("passed")).cast("bigint")).alias("failures"))


def max_intensity_difference(before: DataFrame, after: DataFrame, bin_frames: int = 50, keys: Keys = PLANE) -> DataFrame:
    a, b = (projections.binned_max(m, bin_frames, keys).agg(F.avg("v").alias(n)) for m, n in ((after, "a"), (before, "b")))
    return a.crossJoin(F.broadcast(b)).select((F.col("a") - F.col("b")).alias("difference"))


def image_correlation(a: DataFrame, b: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """Pearson correlation of two images, zero if either doesn't vary."""
    j = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), list(keys))
    return j.agg(or_zero(correlation("a", "b")).alias("correlation"))


def correlation_to_reference(movie: DataFrame, reference: DataFrame | None = None, keys: Keys = PLANE) -> DataFrame:
    """Mean over frames of each frame's correlation with the reference image (the mean image by default)."""
    ref = (projections.mean(movie, keys) if reference is None else reference).withColumnRenamed("v", "ref")
    per = movie.join(ref, list(keys)).groupBy("t").agg(or_zero(correlation("v", "ref")).alias("c"))
    return per.agg(F.avg("c").alias("correlation"))


def singular_values(movie: DataFrame, n: int = 30, keys: Keys = PLANE) -> list[float]:
    """Largest singular values of the pixel-centred movie from its frames x frames Gram matrix.

    The Gram matrix is summed by partition on the executors, one matrix a partition; frames x frames is what reaches the driver."""
    traces = to_trace(movie, keys)
    frames, pixels = traces.agg(F.max(F.size("trace")), F.count(F.lit(1))).first()
    if not pixels:
        return []

    def gram(it):
        total = np.zeros((frames, frames))
        for p in it:
            x = np.array(p["trace"].tolist(), float)
            x -= x.mean(1, keepdims=True)
            total += x.T @ x
        for i in range(frames):
            yield pd.DataFrame({"i": i, "row": [total[i].tolist()]})

    rows = traces.mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    g = np.zeros((frames, frames))
    g[rows["i"], rows["j"]] = rows["g"]
    k = max(0, min(n, min(pixels, frames) - 1))
    return np.sqrt(np.clip(np.linalg.eigvalsh(g)[::-1][:k], 0, None)).tolist()


def column_correlations(vector: DataFrame, matrix: DataFrame) -> DataFrame:
    """(j, r) of vector(i, x) with each column of matrix(i, j, m); nulls and NaNs are left out, each side's mean taken on its own."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    v = vector.select("i", known("x").alias("x"))
    vm = v.agg(F.avg("x").alias("xm"))
    m = matrix.select("i", "j", known("m").alias("m"))
    mm = m.groupBy("j").agg(F.avg("m").alias("mm"))
    d = m.join(mm, "j").join(v, "i").crossJoin(F.broadcast(vm)).select("j", (F.col("x") - F.col("xm")).alias("dx"), (F.col("m") - F.col("mm")).alias("dm"))
    own = lambda k: F.sqrt(F.sum(F.col(k) * F.col(k)))
    return d.groupBy("j").agg(F.try_divide(F.sum(F.col("dx") * F.col("dm")), own("dx") * own("dm")).alias("r"))


def ar1_coefficients(traces: DataFrame, by: str = "id") -> DataFrame:
    """(by, g): lag-one autocovariance over variance, held within [0, 0.998]."""
    w = Window.partitionBy(by)
    d = traces.withColumn("z", F.col("v") - F.avg("v").over(w)).withColumn("prev", F.lag("z").over(w.orderBy("t")))
    e = F.sum(F.col("z") * F.col("z"))
    return d.groupBy(by).agg(F.when(e > 0, F.least(F.greatest(F.sum(F.col("z") * F.col("prev")) / e, F.lit(0.0)), F.lit(0.998))).otherwise(0.0).alias("g"))


def separated_pixels(image: DataFrame, n: int, distance: float, descending: bool = True, keys: Keys = PLANE, block: int = 4096) -> DataFrame:
    """(rank, keys..., v): the n best pixels, none within ``distance`` of a better one; ties by position, pixels without a value take no part.

    The best ``block`` pixels that are near no chosen one come from every task's own best, and are chosen from in order; then those that
    follow. So the driver holds a block and the chosen, each pass chooses one pixel at least, and the first pass is mostly the only one."""
    from lumiframe.operators.graph import _checkpoint

    rest, size = image.filter("v is not null").select(*keys, F.col("v").cast("double").alias("v")), max(distance, 1.0)
    chosen: list = []
    cells: dict[tuple, list] = {}
    around = list(itertools.product((-1, 0, 1), repeat=len(keys)))
    cell = lambda at: tuple(int(np.floor(a / size)) for a in at)
    more = n > 0
    while more:
        best = rest.orderBy(F.desc("v") if descending else F.asc("v"), *keys).limit(block).collect()
        for r in best:
            at = tuple(r[k] for k in keys)
            home = cell(at)
            near = (b for o in around for b in cells.get(tuple(c + d for c, d in zip(home, o, strict=True)), ()))
            if len(chosen) < n and all(sum((a - b) ** 2 for a, b in zip(at, q, strict=True)) >= distance * distance for q in near):
                chosen.append((*at, r["v"]))
                cells.setdefault(home, []).append(at)
        more = len(chosen) < n and len(best) == block
        if more:
            rest = _checkpoint(_after(rest, best[-1], descending, keys).join(F.broadcast(_surroundings(image.sparkSession, chosen, size, keys, around)), [F.floor(F.col(k) / size) == F.col(f"__c{k}") for k in keys] + [_squares(keys) < distance * distance], "left_anti"))
    kinds = ", ".join(f"{k} int" for k in keys)
    return image.sparkSession.createDataFrame([(k, *c) for k, c in enumerate(chosen)], f"rank int, {kinds}, v double")


def _after(pixels: DataFrame, last, descending: bool, keys: Keys) -> DataFrame:
    """The pixels that follow ``last`` in the order."""
    follows, same = (F.col("v") < F.lit(last["v"]) if descending else F.col("v") > F.lit(last["v"])), F.col("v") == F.lit(last["v"])
    for k in keys:
        follows |= same & (F.col(k) > last[k])
        same &= F.col(k) == last[k]
    return pixels.filter(follows)


def _surroundings(spark, chosen: list, size: float, keys: Keys, around: list) -> DataFrame:
    """The chosen pixels in every cell of the grid that they can reach; no more than a few rows for each."""
    rows = [(*c[:-1], *[int(np.floor(a / size)) + b for a, b in zip(c[:-1], o, strict=True)]) for c in chosen for o in around]
    return spark.createDataFrame(rows, ", ".join([f"__p{k} int" for k in keys] + [f"__c{k} bigint" for k in keys]))


def _squares(keys: Keys):
    out = F.lit(0.0)
    for k in keys:
        out += F.pow(F.col(k) - F.col(f"__p{k}"), 2)
    return out


def seed_candidates(image: DataFrame, n: int, distance_fraction: float = 0.05, least: float = 0.3, keys: Keys = PLANE) -> DataFrame:
    extent = image.agg(F.greatest(*[F.max(k) for k in keys]) + 1).first()[0] or 1
    return separated_pixels(image, n, distance_fraction * extent, True, keys).filter(F.col("v") >= least)


def qc_samples(before: DataFrame, after: DataFrame, high: int = 2, low: int = 2, distance_fraction: float = 0.2, keys: Keys = PLANE) -> DataFrame:
    """(kind, rank, keys..., t, before, after): traces of the pixels that co-vary most and least with their neighbours."""
    score = projections.local_correlation(before, keys)
    extent = score.agg(F.greatest(*[F.max(k) for k in keys]) + 1).first()[0] or 1
    d = distance_fraction * extent
    at = separated_pixels(score, high, d, True, keys).withColumn("kind", F.lit("high")).unionByName(separated_pixels(score, low, d, False, keys).withColumn("kind", F.lit("low"))).drop("v")
    both = before.withColumnRenamed("v", "before").join(after.withColumnRenamed("v", "after"), [*keys, "t"])
    return at.join(both, list(keys)).select("kind", "rank", *keys, "t", "before", "after")
