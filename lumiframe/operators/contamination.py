"""Time courses that are robust to contamination: each cell's window is explained by the known profiles and, at a price, by small spots
anywhere in it. What spots explain isn't counted as the cell's activity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import kernels, solvers
from lumiframe.operators import transients

DEFAULTS = {"p": 1e-5, "sigma2": 0.01, "lambda_spot": 20.0, "spot_radius": 1.2, "lambda_profile": 0.0, "pad": 10, "least_pixels": 1, "tol": 0.01, "rounds": 1000}


class CellWindow:
    """The fit of one cell in one window: profiles of the cells seen there, the spot basis, and the penalties."""

    def __init__(self, profiles: np.ndarray, own: int, **options):
        """``profiles``: cells x height x width, cropped to the window."""
        o = {**DEFAULTS, **options}
        self.o = o
        seen = (profiles > 0).sum((1, 2)) > max(o["least_pixels"], 1)
        seen[own] = True
        self.shape = profiles.shape[1:]
        self.rois = profiles[seen].reshape(int(seen.sum()), -1).T
        self.own = int(seen[:own].sum())
        self.n = self.rois.shape[1]
        pixels = self.rois.shape[0]
        sizes = np.maximum(np.linalg.norm(self.rois, axis=0), 1e-300)
        price = np.concatenate((np.full(self.n, o["lambda_profile"]), np.full(pixels, o["lambda_spot"])))
        self.k1 = 2 * o["sigma2"] * price
        self.k2 = 2 * o["sigma2"] * (math.log(1 / o["p"] - 1) - np.log(price[price > 0]).sum())
        self.sizes = np.concatenate((sizes, np.ones(pixels)))
        self.unit = self.rois / sizes
        self.spots = solvers.SpotBasis(solvers.gaussian_blob(o["spot_radius"]), self.shape)
        self.step = 0.0

    def solve(self, frame: np.ndarray) -> dict[str, float]:
        """Least squares on the profiles alone against the fit with spots; the cheaper one is the cell's activity."""
        y = frame.ravel()
        plain = np.linalg.lstsq(self.rois, y, rcond=None)[0]
        spots = lambda z: self.spots(z.reshape(self.shape)).ravel()
        x, self.step = solvers.sparse_fit(
            lambda z: self.unit @ z[: self.n] + spots(z[self.n :]), lambda r: np.concatenate((self.unit.T @ r, spots(r))), y, self.k1 / self.sizes, self.n + len(y), self.o["tol"], self.o["rounds"], self.step
        )
        x = x / self.sizes
        plain_cost = float(((self.rois @ plain - y) ** 2).sum())
        spot_cost = float(((y - self.rois @ x[: self.n] - spots(x[self.n :])) ** 2).sum() + np.abs(self.k1 * x).sum() - self.k2)
        better = plain[self.own] if plain_cost < spot_cost else x[self.own]
        return {"tc": float(better), "tc_lsq": float(plain[self.own]), "tc_spots": float(x[self.own]), "lsq_cost": plain_cost, "spot_cost": spot_cost}


TIME_COURSE = "roi int, t int, tc double, tc_lsq double, lsq_cost double, spot_cost double"


def cell_windows(profiles: DataFrame, height: int, width: int, pad: int = 10) -> DataFrame:
    """(roi, y0, y1, x0, x1): padded inclusive bounds of each profile within the field."""
    b = profiles.filter("w > 0").groupBy("roi").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.min("x").alias("c"), F.max("x").alias("d"))
    lo = lambda c: F.greatest(F.col(c) - pad, F.lit(0)).alias
    hi = lambda c, n: F.least(F.col(c) + pad, F.lit(n - 1)).alias
    return b.select("roi", lo("a")("y0"), hi("b", height)("y1"), lo("c")("x0"), hi("d", width)("x1"))


def time_courses(movie: DataFrame, profiles: DataFrame, height: int, width: int, average: int = 1, blocks: DataFrame | None = None, zero: float = 0.0, **options) -> DataFrame:
    """``TIME_COURSE`` rows of every cell and frame, or of the frames of its blocks (roi, t0, t1) only.

    Frames outside the blocks are left out before the window join: a filter can't be pushed through the grouped fit. Trailing means of
    ``average`` frames start anew in each block. A group is one cell's window over its frames."""
    o = {**DEFAULTS, **options}
    win = cell_windows(profiles, height, width, o["pad"])
    cells = win.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    px = cells.select("roi", "y", "x", "y0", "x0")
    m = movie.withColumn("v", F.col("v") - zero)
    if blocks is None:
        held = m.join(px, ["y", "x"]).withColumn("block", F.lit(0))
    else:
        frames = transients.merge_blocks(blocks.select("roi", "t0", "t1")).select("roi", F.col("t0").alias("block"), F.explode(F.sequence("t0", "t1")).alias("t"))
        held = m.join(px, ["y", "x"]).join(frames, ["roi", "t"])
    if average > 1:
        w = Window.partitionBy("roi", "block", "y", "x").orderBy("t").rowsBetween(-(average - 1), 0)
        held = held.withColumn("v", F.avg("v").over(w))
    near = px.join(profiles.filter("w > 0").select(F.col("roi").alias("other"), "y", "x", "w"), ["y", "x"])

    def fit(own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=["roi", "t", "tc", "tc_lsq", "lsq_cost", "spot_cost"])
        roi, y0, x0 = (int(own[c].iloc[0]) for c in ("roi", "y0", "x0"))
        shape = int(own["y"].max()) - y0 + 1, int(own["x"].max()) - x0 + 1
        others = sorted(set(seen["other"]))
        stack = np.zeros((len(others), *shape))
        index = {o: k for k, o in enumerate(others)}
        stack[seen["other"].map(index), seen["y"] - y0, seen["x"] - x0] = seen["w"]
        cell = CellWindow(stack, index[roi], **{**options, "sigma2": o["sigma2"] / average})
        rows = []
        for t, f in own.sort_values("t").groupby("t"):
            frame = np.zeros(shape)
            frame[f["y"] - y0, f["x"] - x0] = f["v"]
            r = cell.solve(frame)
            rows.append((roi, int(t), r["tc"], r["tc_lsq"], r["lsq_cost"], r["spot_cost"]))
        return pd.DataFrame(rows, columns=["roi", "t", "tc", "tc_lsq", "lsq_cost", "spot_cost"])

    return held.groupBy("roi").cogroup(near.toDF(*near.columns).groupBy("roi")).applyInPandas(fit, TIME_COURSE)


def blocks_of(found: DataFrame, lead: int = 0, tail: int = 0) -> DataFrame:
    """(roi, t0, t1): the merged frame ranges of each cell's transients."""
    return transients.merge_blocks(found.select("roi", F.greatest(F.col("t0") - lead, F.lit(0)).alias("t0"), (F.col("t1") + tail).alias("t1")))


def residual_fractions(shapes: DataFrame, profiles: DataFrame, **options) -> DataFrame:
    """(roi, trans, fraction): (plain - with spots) / plain coefficient of the cell in each transient's shape; null where the plain one is zero."""
    near = shapes.select("roi", "y", "x").distinct().join(profiles.filter("w > 0").select(F.col("roi").alias("other"), "y", "x", "w"), ["y", "x"])

    def fit(own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=["roi", "trans", "fraction"])
        roi, y0, x0 = int(own["roi"].iloc[0]), int(own["y"].min()), int(own["x"].min())
        shape = int(own["y"].max()) - y0 + 1, int(own["x"].max()) - x0 + 1
        others = sorted({*seen["other"], roi})
        index = {c: k for k, c in enumerate(others)}
        stack = np.zeros((len(others), *shape))
        if len(seen):
            stack[seen["other"].map(index), seen["y"] - y0, seen["x"] - x0] = seen["w"]
        cell = CellWindow(stack, index[roi], **options)
        rows = []
        for k, f in own.groupby("trans"):
            image = np.zeros(shape)
            image[f["y"] - y0, f["x"] - x0] = f["shape"].fillna(0)
            r = cell.solve(image)
            rows.append((roi, int(k), (r["tc_lsq"] - r["tc_spots"]) / r["tc_lsq"] if r["tc_lsq"] else None))
        return pd.DataFrame(rows, columns=["roi", "trans", "fraction"])

    return shapes.groupBy("roi").cogroup(near.toDF(*near.columns).groupBy("roi")).applyInPandas(fit, "roi int, trans long, fraction double")


CRITERIA = ("corr", "res_ratio", "residual")


def classify(shapes: DataFrame, profiles: DataFrame, criterion: str = "corr", corr: float = 0.4, ratio: float = 0.5, residual: float = 0.5, blur: float = 1.0, ignore_zeros: bool = True, **options) -> DataFrame:
    """(roi, trans, class, corr, ratio): each shape is fitted, blurred, by all profiles of its window; the ratio compares what is left with
    the cell to what is left without it. True (1) or false (-1) by one criterion."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    near = shapes.select("roi", "y", "x").distinct().join(profiles.filter("w > 0").select(F.col("roi").alias("other"), "y", "x", "w"), ["y", "x"])

    def fit(own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=["roi", "trans", "corr", "ratio"])
        roi, y0, x0 = int(own["roi"].iloc[0]), int(own["y"].min()), int(own["x"].min())
        shape = int(own["y"].max()) - y0 + 1, int(own["x"].max()) - x0 + 1
        ids = [roi, *sorted({*seen["other"]} - {roi})]
        index = {c: k for k, c in enumerate(ids)}
        stack = np.zeros((len(ids), *shape))
        if len(seen):
            stack[seen["other"].map(index), seen["y"] - y0, seen["x"] - x0] = seen["w"]
        design = stack.reshape(len(ids), -1).T
        own_profile = design[:, 0]
        rows = []
        for k, f in own.groupby("trans"):
            image = np.zeros(shape)
            image[f["y"] - y0, f["x"] - x0] = f["shape"].fillna(0)
            target = kernels.blur(image, blur, "nearest").ravel()
            x = np.linalg.lstsq(design, target, rcond=None)[0]
            left, without = ((target - design @ x) ** 2).sum(), ((target - design[:, 1:] @ x[1:]) ** 2).sum()
            use = own_profile > 0 if ignore_zeros else np.ones(len(own_profile), bool)
            a, b = own_profile[use] - own_profile[use].mean(), image.ravel()[use] - image.ravel()[use].mean()
            n = np.linalg.norm(a) * np.linalg.norm(b)
            rows.append((roi, int(k), float(a @ b / n) if n else None, float(left / without) if without else None))
        return pd.DataFrame(rows, columns=["roi", "trans", "corr", "ratio"])

    got = shapes.groupBy("roi").cogroup(near.toDF(*near.columns).groupBy("roi")).applyInPandas(fit, "roi int, trans long, corr double, ratio double")
    yes = {"corr": F.col("corr") >= corr, "res_ratio": F.col("ratio") <= ratio}
    if criterion == "residual":
        got = got.join(residual_fractions(shapes, profiles, **options), ["roi", "trans"])
        yes["residual"] = F.col("fraction") >= residual
    return got.withColumn("class", F.when(F.coalesce(yes[criterion], F.lit(False)), 1.0).otherwise(-1.0))


def profiles_of(regions: DataFrame, grid: DataFrame, sigma: float = 1.5, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """(roi, y, x, w): region masks blurred. The blur of a mask is a sum over its pixels, so each pixel sends its kernel."""
    taps = kernels.gaussian_taps(sigma)
    r = len(taps) // 2
    every = F.array(*[F.struct(F.lit(k - r).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(taps)])
    sent = regions.select("roi", *keys).withColumn("__a", F.explode(every)).withColumn("__b", F.explode(every))
    moved = sent.select("roi", (F.col(keys[0]) + F.col("__a.o")).alias(keys[0]), (F.col(keys[1]) + F.col("__b.o")).alias(keys[1]), (F.col("__a.w") * F.col("__b.w")).alias("w"))
    return moved.join(grid.select(*keys), list(keys), "left_semi").groupBy("roi", *keys).agg(F.sum("w").alias("w"))


class TimeCourses:
    """A movie, its profiles and the runs of time courses over them, by name: ``default``, ``contaminated`` or a run's number."""

    def __init__(self, movie: DataFrame, profiles: DataFrame, height: int, width: int):
        missing = [c for c in ("roi", "y", "x", "w") if c not in profiles.columns]
        if missing:
            raise ValueError(f"not profiles: no column {', '.join(missing)}")
        self.movie, self.profiles, self.shape = movie, profiles, (height, width)
        self.named: dict[str, DataFrame] = {}
        self.runs: list[DataFrame] = []

    def run(self, blocks: DataFrame | None = None, **options) -> DataFrame:
        self.runs.append(time_courses(self.movie, self.profiles, *self.shape, blocks=blocks, **options))
        return self.runs[-1]

    def get(self, which: str | int = "default") -> DataFrame:
        if isinstance(which, int):
            if not -len(self.runs) <= which < len(self.runs):
                raise KeyError(f"no run {which}")
            return self.runs[which]
        if which not in self.named:
            raise KeyError(f"no time course named {which}")
        return self.named[which]

    def latest(self) -> DataFrame:
        """Of all runs, each cell's latest."""
        every = None
        for k, r in enumerate(self.runs):
            own = r.select(F.lit(k).alias("run"), "roi", "t", "tc")
            every = own if every is None else every.unionByName(own)
        return transients.latest_time_course(every)
