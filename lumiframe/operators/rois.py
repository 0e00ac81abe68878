"""Growing a region around a seed by correlation. Each seed works on the disk around it, so seeds run in parallel and a group holds no more than a disk's pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.functions import kernels
from lumiframe.functions.columns import correlation, or_zero
from lumiframe.operators.masks import clean_region

GROWTH = ("local_corr_threshold", "flood_fill")
OBJECTIVES = ("cellnpdecorr", "cellnpdiff")
SEARCH_FRAMES = 1000


def seed_trace(movie: DataFrame, y: int, x: int, radius: int = 0) -> DataFrame:
    """(t, v): the seed's pixel, or the mean of the block around it."""
    return movie.filter(F.col("y").between(y - radius, y + radius) & F.col("x").between(x - radius, x + radius)).groupBy("t").agg(F.avg("v").alias("v"))


def seed_correlations(movie: DataFrame, y: int, x: int, reach: float = 15, radius: int = 0) -> DataFrame:
    """(y, x, v): correlation of every pixel of the disk with the seed's trace, zero for a pixel that doesn't vary."""
    near = movie.filter(F.pow(F.col("y") - y, 2) + F.pow(F.col("x") - x, 2) <= reach * reach)
    return near.join(seed_trace(movie, y, x, radius).withColumnRenamed("v", "s"), "t").groupBy("y", "x").agg(or_zero(correlation("v", "s")).alias("v"))


def _correlations(traces: np.ndarray, ref: np.ndarray) -> np.ndarray:
    z, r = traces - traces.mean(-1, keepdims=True), ref - ref.mean()
    n = np.linalg.norm(z, axis=-1) * np.linalg.norm(r)
    return np.divide(z @ r, n, out=np.zeros(traces.shape[:-1]), where=n > 0)


def objective(trace: np.ndarray, neuropil: np.ndarray, kind: str) -> float:
    if kind == "cellnpdecorr":
        return -float(_correlations(trace[None], neuropil)[0])
    var = neuropil.var(ddof=1)
    return float(((trace - neuropil) / var).sum()) if var else -np.inf


def grow(cube: np.ndarray, inside: np.ndarray, seed: tuple[int, int], threshold: float, growth: str, radius: int = 0, image: np.ndarray | None = None) -> np.ndarray:
    """The region of one threshold within a window (y, x, t); ``inside`` is the disk."""
    if growth == "local_corr_threshold":
        r = max(radius, 0)
        score = image
        if score is None:
            block = cube[max(seed[0] - r, 0) : seed[0] + r + 1, max(seed[1] - r, 0) : seed[1] + r + 1]
            score = _correlations(cube, np.nanmean(block, axis=(0, 1)))
        return clean_region((score > threshold) & inside, seed)
    mask = np.zeros(inside.shape, bool)
    mask[seed] = True
    while True:
        edge = kernels.dilate(mask, [(0, 0), *kernels.neighbour_offsets(2)]) & inside & ~mask
        at = np.argwhere(edge)
        if not len(at):
            return mask
        new = at[_correlations(cube[tuple(at.T)], cube[mask].mean(0)) > threshold]
        if not len(new):
            return mask
        mask[tuple(new.T)] = True


def ring_of(mask: np.ndarray, inner: float = 2, outer: float = 4) -> np.ndarray:
    return kernels.dilate(mask, kernels.disk_offsets(outer)) & ~kernels.dilate(mask, kernels.disk_offsets(inner))


def best_threshold(cube, inside, known, seed, kind, growth, radius=0, image=None) -> float:
    """The threshold with the largest objective, the smallest of equals: 0.60 to 0.90 first, 0.05 to 0.59 if none gives a region; 0.6 if none does at all."""
    c = cube[..., :SEARCH_FRAMES]
    for sweep in (np.linspace(0.6, 0.9, 31), np.linspace(0.05, 0.59, 55)):
        best = (-np.inf, None)
        for thr in sweep:
            m = grow(c, inside, seed, thr, growth, radius, image)
            ring = ring_of(m) & known
            if m.any() and ring.any():
                value = objective(c[m].mean(0), c[ring].mean(0), kind)
                if value > best[0]:
                    best = (value, float(thr))
        if best[1] is not None:
            return best[1]
    return 0.6


def from_seeds(movie: DataFrame, seeds: DataFrame, threshold: float | None = None, reach: float = 15, kind: str = "cellnpdecorr", growth: str = "local_corr_threshold", radius: int = 0, image: DataFrame | None = None) -> DataFrame:
    """(seed, y, x, threshold): the region of each seed (seed, sy, sx).

    Pixels are sent to the seeds whose window holds them by an equi-join on a grid of window-sized cells, not by comparing all with all."""
    if kind not in OBJECTIVES or growth not in GROWTH:
        raise ValueError(f"kind must be one of {OBJECTIVES}, growth one of {GROWTH}")
    if threshold is not None and abs(threshold) > 1:
        raise ValueError("a correlation threshold lies within [-1, 1]")
    pad = int(np.ceil(reach)) + 5
    cell = 2 * pad + 1
    c = lambda k: F.floor(F.col(k) / cell).cast("int")
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    s = seeds.withColumn("o", F.explode(near)).select("seed", "sy", "sx", (c("sy") + F.col("o.a")).alias("cy"), (c("sx") + F.col("o.b")).alias("cx"))
    m = movie if image is None else movie.join(image.withColumnRenamed("v", "score"), ["y", "x"])
    held = m.withColumn("cy", c("y")).withColumn("cx", c("x")).join(s, ["cy", "cx"]).filter((F.abs(F.col("y") - F.col("sy")) <= pad) & (F.abs(F.col("x") - F.col("sx")) <= pad)).drop("cy", "cx")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(p["y"].min()), int(p["x"].min())
        y, x, t = (p[k].to_numpy() - o for k, o in (("y", y0), ("x", x0), ("t", 0)))
        ts, ti = np.unique(t, return_inverse=True)
        cube = np.zeros((y.max() + 1, x.max() + 1, len(ts)))
        known = np.zeros(cube.shape[:2], bool)
        cube[y, x, ti], known[y, x] = p["v"], True
        score = None
        if "score" in p:
            score = np.full(known.shape, -np.inf)
            score[y, x] = p["score"]
        seed = int(p["sy"].iloc[0]) - y0, int(p["sx"].iloc[0]) - x0
        gy, gx = np.mgrid[: known.shape[0], : known.shape[1]]
        inside = ((gy - seed[0]) ** 2 + (gx - seed[1]) ** 2 <= reach * reach) & known
        thr = abs(threshold) if threshold is not None else best_threshold(cube, inside, known, seed, kind, growth, radius, score)
        at = np.argwhere(grow(cube, inside, seed, thr, growth, radius, score))
        return pd.DataFrame({"seed": int(p["seed"].iloc[0]), "y": at[:, 0] + y0, "x": at[:, 1] + x0, "threshold": thr})

    return held.groupBy("seed").applyInPandas(one, "seed int, y int, x int, threshold double")
