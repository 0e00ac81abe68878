"""Masks, regions, morphology and region traces. A mask is a set of pixels; a region table has (roi, keys...)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.functions import kernels
from lumiframe.operators import projections
from lumiframe.operators.movie import PLANE, VOLUME
from lumiframe.operators.normalize import histogram

Keys = Sequence[str]
METHODS = ("triangle", "otsu", "manual", "percentile")


def above(image: DataFrame, threshold: float) -> DataFrame:
    """(keys..., inside): strictly above the threshold."""
    return image.withColumn("inside", F.col("v") > threshold).drop("v")


def _cut(image: DataFrame, threshold: DataFrame) -> DataFrame:
    return image.crossJoin(F.broadcast(threshold)).withColumn("inside", F.col("v") > F.col("thr")).drop("v", "thr")


def percentile_mask(image: DataFrame, percent: float) -> DataFrame:
    """The brightest ``percent`` of the pixels."""
    return _cut(image, image.agg(F.percentile("v", F.lit(1 - percent / 100)).alias("thr")))


def otsu_threshold(image: DataFrame, bins: int = 256) -> DataFrame:
    """One row (thr): running sums over a histogram of ``bins`` rows, the best split by ``max_by``."""
    from pyspark.sql import Window

    h = histogram(image, bins)
    width = image.agg(((F.max("v") - F.min("v")) / bins).alias("w"))
    h = h.crossJoin(F.broadcast(width)).select("bin", "n", (F.col("lo") + F.col("w") / 2).alias("c"))
    w = Window.orderBy("bin")  # a histogram: ``bins`` rows
    run = h.select("bin", "c", F.sum("n").over(w).alias("n1"), F.sum(F.col("n") * F.col("c")).over(w).alias("s1"), F.sum("n").over(Window.partitionBy()).alias("nn"), F.sum(F.col("n") * F.col("c")).over(Window.partitionBy()).alias("ss"))
    n2, s2 = F.col("nn") - F.col("n1"), F.col("ss") - F.col("s1")
    between = F.when((F.col("n1") > 0) & (n2 > 0), F.col("n1") * n2 * F.pow(F.col("s1") / F.col("n1") - s2 / n2, 2))
    return run.withColumn("b", between).agg(F.max_by("c", F.struct(F.coalesce(F.col("b"), F.lit(-1.0)), -F.col("bin"))).alias("thr"))


def otsu_mask(image: DataFrame) -> DataFrame:
    return _cut(image, otsu_threshold(image))


def triangle_threshold(image: DataFrame, bins: int = 256) -> float:
    """Triangle rule on a histogram of ``bins`` rows, the only thing that reaches the driver."""
    h = histogram(image, bins).orderBy("bin").toPandas()
    ends = image.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    if ends["a"] is None or ends["a"] == ends["b"]:
        return float(ends["a"] or 0.0)
    centres = h["lo"].to_numpy() + (ends["b"] - ends["a"]) / bins / 2
    return kernels.triangle_of(h["n"].to_numpy(), centres)


def compute(image: DataFrame, method: str, threshold: float = 0.0, percent: float = 10.0) -> DataFrame:
    if method == "triangle":
        return above(image, triangle_threshold(image))
    if method == "otsu":
        return otsu_mask(image)
    if method == "manual":
        return above(image, threshold)
    if method == "percentile":
        return percentile_mask(image, percent)
    raise ValueError(f"method must be one of {METHODS}")


def apply(movie: DataFrame, mask: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """Samples outside the mask become zero; none is dropped."""
    own = mask.filter("inside").select(*keys, F.lit(True).alias("__in")).distinct()
    return movie.join(own, list(keys), "left").select(*keys, "t", F.when(F.col("__in"), F.col("v")).otherwise(0.0).alias("v"))


def stage(movie: DataFrame, method: str, keys: Keys = PLANE, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(masked movie, mask, one row fraction_kept) from the mean projection."""
    mask = compute(projections.mean(movie, keys), method, **options)
    return apply(movie, mask, keys), mask, mask.agg(F.avg(F.col("inside").cast("double")).alias("fraction_kept"))


def disk(grid: DataFrame, centre: tuple[float, ...], radius: float, keys: Keys = PLANE) -> DataFrame:
    """The grid's pixels within ``radius`` of the centre."""
    d = sum(((F.col(k) - c) * (F.col(k) - c) for k, c in zip(keys, centre, strict=True)), F.lit(0.0))
    return grid.filter(d <= radius * radius)


def region_traces(movie: DataFrame, regions: DataFrame, keys: Keys = PLANE, frames: int | None = None) -> DataFrame:
    """(roi, t, v): mean of each region in each frame, zero for a region without pixels in the movie; at most ``frames`` frames."""
    m = movie if frames is None else movie.filter(F.col("t") < frames)
    got = m.join(regions.select("roi", *keys), list(keys)).groupBy("roi", "t").agg(F.avg("v").alias("v"))
    times = m.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    every = regions.select("roi").distinct().crossJoin(F.broadcast(times)).select("roi", F.explode(F.sequence("a", "b")).alias("t"))
    return every.join(got, ["roi", "t"], "left").select("roi", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def offsets_table(df: DataFrame, offsets: Sequence[tuple[int, ...]], keys: Keys = PLANE) -> DataFrame:
    """``df`` repeated for each offset, its keys moved by it."""
    every = F.array(*[F.struct(*[F.lit(int(o)).alias(k) for k, o in zip(keys, off, strict=True)]) for off in offsets])
    others = [c for c in df.columns if c not in keys]
    return df.withColumn("__o", F.explode(every)).select(*others, *[(F.col(k) + F.col(f"__o.{k}")).alias(k) for k in keys])


def dilate(mask: DataFrame, offsets: Sequence[tuple[int, ...]], grid: DataFrame, keys: Keys = PLANE, by: Sequence[str] = ()) -> DataFrame:
    """Pixels of the grid that some offset of a mask pixel reaches; ``by`` columns keep masks apart. What leaves the grid is lost."""
    moved = offsets_table(mask.select(*by, *keys), offsets, keys).distinct()
    return moved.join(grid.select(*keys), list(keys), "left_semi")


def neuropil_rings(regions: DataFrame, grid: DataFrame, inner: float = 2, outer: float = 4, keys: Keys = PLANE) -> DataFrame:
    """(roi, keys...): the pixels between the two dilations that belong to no region."""
    far = dilate(regions, kernels.disk_offsets(outer), grid, keys, ["roi"])
    near = dilate(regions, kernels.disk_offsets(inner), grid, keys, ["roi"])
    return far.join(near, ["roi", *keys], "left_anti").join(regions.select(*keys).distinct(), list(keys), "left_anti")


def neuropil_traces(movie: DataFrame, regions: DataFrame, inner: float = 2, outer: float = 4, keys: Keys = PLANE) -> DataFrame:
    grid = movie.select(*keys).distinct()
    rings = neuropil_rings(regions, grid, inner, outer, keys)
    got = region_traces(movie, rings, keys)
    return got


def centres(footprints: DataFrame, keys: Keys = PLANE) -> DataFrame:
    """(roi, c_key..., lo_key..., hi_key...): centre of mass of |w| and inclusive bounds of the non-zero weights."""
    w = F.abs(F.col("w"))
    on = footprints.filter("w <> 0")
    com = [F.try_divide(F.sum(w * F.col(k)), F.sum(w)).alias(f"c_{k}") for k in keys]
    return on.groupBy("roi").agg(*com, *[F.min(k).alias(f"lo_{k}") for k in keys], *[F.max(k).alias(f"hi_{k}") for k in keys])


def components(mask: DataFrame, keys: Keys = PLANE, by: str = "roi", corners: bool = True) -> DataFrame:
    """(by, keys..., label): connected components of each mask, numbered in scan order, by a flood fill within its bounding box. One mask is one group: masks are footprints, not whole fields."""

    def flood(p: pd.DataFrame) -> pd.DataFrame:
        at = p[list(keys)].to_numpy()
        lo = at.min(0)
        grid = np.zeros(tuple(at.max(0) - lo + 1), bool)
        grid[tuple((at - lo).T)] = True
        lab, _ = kernels.label(grid, corners)
        return p[[by, *keys]].assign(label=lab[tuple((at - lo).T)].astype("int32"))

    kinds = ", ".join(f"{c} {mask.schema[c].dataType.simpleString()}" for c in (by, *keys))
    return mask.groupBy(by).applyInPandas(flood, f"{kinds}, label int")


def threshold_footprints(footprints: DataFrame, quantile: float = 0.5, keys: Keys = PLANE) -> DataFrame:
    """Weights at or over the quantile of the footprint's non-zero weights, and of these the component that holds the peak."""

    def cut(p: pd.DataFrame) -> pd.DataFrame:
        on = p[p["w"] > 0]
        if on.empty:
            return on[["roi", *keys, "w"]]
        on = on[on["w"] >= np.quantile(on["w"], quantile)].sort_values(list(keys))
        at = on[list(keys)].to_numpy()
        lo = at.min(0)
        grid = np.zeros(tuple(at.max(0) - lo + 1), bool)
        grid[tuple((at - lo).T)] = True
        lab = kernels.label(grid)[0][tuple((at - lo).T)]
        return on[lab == lab[int(on["w"].to_numpy().argmax())]][["roi", *keys, "w"]]

    kinds = ", ".join(f"{c} {footprints.schema[c].dataType.simpleString()}" for c in ("roi", *keys))
    return footprints.groupBy("roi").applyInPandas(cut, f"{kinds}, w double")


def clean_region(grid: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """The component at the seed (or nearest to it), with others between half its size and its size, holes filled."""
    lab, n = kernels.label(grid)
    if not n:
        return np.zeros_like(grid, bool)
    own = lab[seed]
    if not own:
        at = np.argwhere(lab > 0)
        own = lab[tuple(at[((at - np.array(seed)) ** 2).sum(1).argmin()])]
    sizes = np.bincount(lab.ravel())
    keep = [k for k in range(1, n + 1) if k == own or sizes[own] / 2 <= sizes[k] <= sizes[own]]
    return kernels.fill_holes(np.isin(lab, keep))


def project_mask(mask: DataFrame, keys: Keys = VOLUME) -> DataFrame:
    """A volume mask seen along its last key."""
    return mask.select(*[c for c in mask.columns if c != keys[-1]]).distinct()


def boxes_overlap(a: str, b: str, keys: Keys = PLANE):
    """Whether the inclusive bounds lo_/hi_ under two struct columns share a cell."""
    out = F.lit(True)
    for k in keys:
        out &= (F.col(f"{a}.lo_{k}") <= F.col(f"{b}.hi_{k}")) & (F.col(f"{b}.lo_{k}") <= F.col(f"{a}.hi_{k}"))
    return out


def box_contains(a: str, b: str, keys: Keys = PLANE):
    """Whether the bounds of ``a`` hold those of ``b``."""
    out = F.lit(True)
    for k in keys:
        out &= (F.col(f"{a}.lo_{k}") <= F.col(f"{b}.lo_{k}")) & (F.col(f"{b}.hi_{k}") <= F.col(f"{a}.hi_{k}"))
    return out


def box_union(a: str, b: str, keys: Keys = PLANE):
    return F.struct(*[F.least(f"{a}.lo_{k}", f"{b}.lo_{k}").alias(f"lo_{k}") for k in keys], *[F.greatest(f"{a}.hi_{k}", f"{b}.hi_{k}").alias(f"hi_{k}") for k in keys])


def overlapping_boxes(boxes: DataFrame, cell: int = 32, keys: Keys = PLANE) -> DataFrame:
    """(a, b, contains, union) of regions (roi, lo_..., hi_...) whose bounds overlap. Bounds are sent to the grid cells they touch and meet
    there, so the interval join is an equi-join; a pair is told by the cell of its overlap's first corner alone, so none is told twice."""
    box = F.struct(*[F.col(f"{e}_{k}") for k in keys for e in ("lo", "hi")])
    at = boxes.select("roi", box.alias("box"))
    for k in keys:
        at = at.withColumn(f"__{k}", F.explode(F.sequence(F.floor(F.col(f"box.lo_{k}") / cell), F.floor(F.col(f"box.hi_{k}") / cell))))
    cells = [f"__{k}" for k in keys]
    other = at.select(F.col("roi").alias("b"), F.col("box").alias("bb"), *cells)
    j = at.withColumnRenamed("roi", "a").withColumnRenamed("box", "ba").join(other, cells).filter((F.col("a") < F.col("b")) & boxes_overlap("ba", "bb", keys))
    for k in keys:
        j = j.filter(F.col(f"__{k}") == F.floor(F.greatest(f"ba.lo_{k}", f"bb.lo_{k}") / cell))
    return j.select("a", "b", box_contains("ba", "bb", keys).alias("contains"), box_union("ba", "bb", keys).alias("union"))
