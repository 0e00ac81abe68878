"""Volume views and region overlays."""

from __future__ import annotations

import colorsys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.operators.movie import VOLUME

Keys = Sequence[str]


def downsample(volume: DataFrame, target: int = 200, shape: Sequence[int] | None = None, keys: Keys = VOLUME, factors: Sequence[int] | None = None) -> DataFrame:
    """Mean over cubes so that no side is much longer than ``target``, or of ``factors`` cells; a rest that fills no cube is trimmed."""
    if shape is None:
        got = volume.agg(*[(F.max(k) + 1).alias(k) for k in keys]).first()
        shape = [got[k] for k in keys]
    f = factors or [max(1, round(n / target)) for n in shape]
    inside = F.lit(True)
    for k, n, s in zip(keys, shape, f, strict=True):
        if s > 1:
            inside &= F.col(k) < n // s * s
    return volume.filter(inside).groupBy(*[F.floor(F.col(k) / s).cast("int").alias(k) for k, s in zip(keys, f, strict=True)]).agg(F.avg("v").alias("v"))


def normalise(volume: DataFrame, percent: float = 99.5) -> DataFrame:
    """v over its percentile, held within [0, 1]."""
    top = volume.agg(F.greatest(F.percentile("v", F.lit(percent / 100)), F.lit(1e-6)).alias("__top"))
    return volume.crossJoin(F.broadcast(top)).withColumn("v", F.least(F.greatest(F.col("v") / F.col("__top"), F.lit(0.0)), F.lit(1.0))).drop("__top")


def project(volume: DataFrame, mode: str = "mip", gamma: float = 1.6, density: float = 3.0, along: str = "l", keys: Keys = VOLUME) -> DataFrame:
    """The view along one axis, scaled to a maximum of one: the maximum, or emission and absorption front to back."""
    rest = [k for k in keys if k != along]
    if mode == "mip":
        image = volume.groupBy(*rest).agg(F.max("v").alias("v"))
    elif mode == "composite":
        alpha = F.least(F.pow("v", F.lit(gamma)) * density, F.lit(1.0))
        w = Window.partitionBy(*rest).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        passed = F.when(F.col("a") < 1, F.log1p(-F.col("a"))).otherwise(-1e6)
        lit = volume.withColumn("a", alpha).withColumn("through", F.exp(F.coalesce(F.sum(passed).over(w), F.lit(0.0))))
        image = lit.groupBy(*rest).agg(F.sum(F.col("v") * F.col("a") * F.col("through")).alias("v"))
    else:
        raise ValueError("mode must be mip or composite")
    top = image.agg(F.max("v").alias("__top"))
    return image.crossJoin(F.broadcast(top)).withColumn("v", F.col("v") / F.greatest(F.col("__top"), F.lit(1e-6))).drop("__top")


def rotate(volume: np.ndarray, azimuth: float, elevation: float) -> np.ndarray:
    """Trilinear resampling about the centre; outside is zero."""
    a, e = np.deg2rad([azimuth, elevation])
    ra = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    re = np.array([[np.cos(e), -np.sin(e), 0], [np.sin(e), np.cos(e), 0], [0, 0, 1]])
    centre = (np.array(volume.shape) - 1) / 2
    at = np.tensordot(re @ ra, np.indices(volume.shape) - centre[:, None, None, None], 1) + centre[:, None, None, None]
    lo = np.floor(at).astype(int)
    out = np.zeros(volume.shape)
    for corner in np.ndindex(2, 2, 2):
        i = lo + np.array(corner)[:, None, None, None]
        w = np.prod(1 - np.abs(at - i), axis=0)
        ok = np.all([(i[k] >= 0) & (i[k] < volume.shape[k]) for k in range(3)], axis=0)
        out[ok] += w[ok] * volume[i[0][ok], i[1][ok], i[2][ok]]
    return out


ALPHA = {"accepted": 1.0, "candidate": 0.5, "rejected": 0.08}


def hue(k: int, n: int) -> tuple[float, float, float]:
    return colorsys.hsv_to_rgb(k / max(1, n), 1.0, 1.0)


def overlay(regions: DataFrame, status: DataFrame, keys: Keys = ("y", "x")) -> DataFrame:
    """(keys..., r, g, b, a): regions (roi, keys...) laid over each other in the order of their position in ``status`` (roi, pos, status)."""
    n = status.count()

    @F.pandas_udf("r double, g double, b double, a double")
    def over(layers: pd.Series) -> pd.DataFrame:
        out = []
        for pixel in layers:
            c, a = np.zeros(3), 0.0
            for layer in sorted(pixel, key=lambda z: z["pos"]):
                own, k = ALPHA.get(layer["status"], 0.5), np.array(hue(layer["pos"], n))
                total = own + a * (1 - own)
                c, a = (k * own + c * a * (1 - own)) / total if total else c, total
            out.append((*c, a))
        return pd.DataFrame(out, columns=["r", "g", "b", "a"])

    j = regions.join(status, "roi").groupBy(*keys).agg(F.collect_list(F.struct("pos", "status")).alias("z"))
    return j.select(*keys, over("z").alias("c")).select(*keys, "c.*")
