"""Per-pixel summaries over time, and depth projections. Input: a movie in long form; output: an image (keys..., v)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiframe.functions import kernels
from lumiframe.functions.columns import correlation, or_zero
from lumiframe.operators import stencil
from lumiframe.operators.movie import PLANE, VOLUME, to_trace

Keys = Sequence[str]


def _over_time(movie: DataFrame, keys: Keys, value: Column) -> DataFrame:
    return movie.groupBy(*keys).agg(value.alias("v"))


def mean(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    return _over_time(movie, keys, F.avg("v"))


def median(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """Exact; the mean of the middle two for an even count."""
    return _over_time(movie, keys, F.percentile("v", F.lit(0.5)))


def variance(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """Population variance."""
    return _over_time(movie, keys, F.var_pop("v"))


def fano_factor(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """Variance over mean, zero where the mean isn't positive."""
    return _over_time(movie, keys, F.when(F.avg("v") > 0, F.var_pop("v") / F.avg("v")).otherwise(0.0))


def half_sample_mode(values: Column) -> Column:
    """Half-sample mode of an array column, in expressions: the narrowest half is kept until three values or fewer are left."""
    s0 = F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))

    def halve(s: Column, _: Column) -> Column:
        n = F.size(s)
        half = F.ceil(n / 2).cast("int")
        widths = F.transform(F.sequence(F.lit(1), n - half), lambda i: F.struct((F.element_at(s, i + half - 1) - F.element_at(s, i)).alias("w"), i.alias("i")))
        return F.when(n <= 3, s).otherwise(F.slice(s, F.array_min(widths)["i"], half))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    s = F.aggregate(steps, s0, halve)
    e = lambda k: F.element_at(s, k)
    left, right = e(2) - e(1), e(3) - e(2)
    of_three = F.when(left < right, (e(1) + e(2)) / 2).when(left > right, (e(2) + e(3)) / 2).otherwise(e(2))
    return F.when(F.size(s) == 1, e(1)).when(F.size(s) == 2, (e(1) + e(2)) / 2).when(F.size(s) == 3, of_three)


def mode(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """Half-sample mode of each pixel; the traces of an Arrow batch that are of one length and finite are halved together."""

    @F.pandas_udf("double")
    def of(traces: pd.Series) -> pd.Series:
        out, sizes = np.full(len(traces), np.nan), traces.map(len).to_numpy()
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            rows = np.stack([np.asarray(traces.iloc[k], float) for k in at])
            whole = np.isfinite(rows).all(1)
            out[at[whole]] = kernels.half_sample_modes(rows[whole])
            out[at[~whole]] = [kernels.half_sample_mode(r) for r in rows[~whole]]
        return pd.Series(out)

    return to_trace(movie, keys).select(*keys, of("trace").alias("v"))


def mode_by_expression(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """The same without Python; for short traces, and as a check."""
    return movie.groupBy(*keys).agg(F.collect_list("v").alias("a")).select(*keys, half_sample_mode(F.col("a")).alias("v"))


def neighbour_mean(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """(keys..., t, own, nb): each sample with the mean of its neighbours in bounds (null without any).

    Samples are sent to their neighbours and meet there in one shuffle on the pixel, which later per-pixel aggregates reuse."""
    offsets = kernels.neighbour_offsets(len(keys))
    every = F.array(*[F.struct(*[F.lit(o).alias(k) for k, o in zip(keys, off, strict=True)]) for off in [(0,) * len(keys), *offsets]])
    sent = movie.withColumn("__o", F.explode(every))
    here = F.lit(True)
    for k in keys:
        here &= F.col(f"__o.{k}") == 0
    sent = sent.select(*[(F.col(k) + F.col(f"__o.{k}")).alias(k) for k in keys], "t", F.when(here, F.col("v")).alias("own"), F.when(~here, F.col("v")).alias("nb"))
    return sent.repartition(*keys).groupBy(*keys, "t").agg(F.max("own").alias("own"), F.avg("nb").alias("nb")).filter("own is not null")


def local_correlation(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """Correlation of each pixel with the mean of its neighbours, zero where either doesn't vary. The movie and the edges of its tiles are exchanged once."""
    return stencil.apply(movie, keys, 1, stencil.NeighbourCorrelation, ", ".join((*keys, "v")))


def local_correlation_by_expression(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """The same without Python, each sample sent to all of its neighbours; as a check."""
    return neighbour_mean(movie, keys).groupBy(*keys).agg(or_zero(correlation("own", "nb")).alias("v"))


def _by_length(traces: pd.Series, kernel) -> pd.Series:
    """``kernel`` of each trace, applied to the matrix of all traces of a length."""
    out = np.zeros(len(traces))
    sizes = traces.map(len).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[at] = kernel(np.stack(traces.iloc[at].to_list()).astype(float)) if n else np.nan
    return pd.Series(out)


def noise_std(movie: DataFrame, keys: Keys = PLANE, band: tuple[float, float] = (0.25, 0.5)) -> DataFrame:
    """Noise level of each pixel from the high-frequency part of its Welch spectrum."""

    @F.pandas_udf("double")
    def of(traces: pd.Series) -> pd.Series:
        return _by_length(traces, lambda x: kernels.noise_stds(x, band))

    return to_trace(movie, keys).select(*keys, of("trace").alias("v"))


def peak_to_noise(movie: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """(maximum - median) over noise."""

    @F.pandas_udf("double")
    def of(traces: pd.Series) -> pd.Series:
        return _by_length(traces, lambda x: (x.max(-1) - np.median(x, -1)) / np.maximum(kernels.noise_stds(x), 1e-6))

    return to_trace(movie, keys).select(*keys, of("trace").alias("v"))


def depth(volume: DataFrame, how: str = "max", keys: Keys = VOLUME) -> DataFrame:
    """A volume's movie of planes: the maximum or mean along its last spatial key."""
    if how not in ("max", "mean"):
        raise ValueError(f"unknown depth projection {how!r}")
    value = F.max("v") if how == "max" else F.avg("v")
    return volume.groupBy(*keys[:-1], "t").agg(value.alias("v"))


def binned_max(movie: DataFrame, bin_frames: int = 50, keys: Keys = PLANE, n_frames: int | None = None) -> DataFrame:
    """Maximum over bins of each bin's mean; a last, shorter bin is dropped unless it is the only one."""
    if n_frames is None:
        n_frames = movie.agg((F.max("t") + 1).alias("n")).first()["n"] or 0
    size = bin_frames if n_frames >= bin_frames else max(1, n_frames)
    whole = movie.filter(F.col("t") < n_frames // size * size)
    # partial sums by (pixel, bin) meet on the pixel, and the maximum needs no second shuffle
    binned = whole.select(*keys, F.floor(F.col("t") / size).alias("b"), "v").repartition(*keys).groupBy(*keys, "b").agg(F.avg("v").alias("m"))
    return binned.groupBy(*keys).agg(F.max("m").alias("v"))
