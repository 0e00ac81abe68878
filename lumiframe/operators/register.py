"""Motion correction as Spark jobs: frames are registered in parallel to a template that is a written table (``template``).

Frames within a bin share a template and are independent, so each bin is one grouped job over its frames; bins follow each other, since
a bin's median is the next bin's template. Registered bins are parts of one table in the shared folder: later bins don't repeat earlier ones, and
the registered movie is one scan, however many bins it had. No image passes the driver but a light template on its way to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.functions import registration as reg
from lumiframe.operators.movie import PLANE
from lumiframe.operators.template import Template, new_path, pack, per_frame, written

METHODS = ("rigid", "patch", "patchwarp")


def bootstrap_template(movie: DataFrame, first: int = 100, keys: Sequence[str] = PLANE) -> DataFrame:
    """Median image of the first frames; the frame limit reaches the scan."""
    return _median(movie.filter(F.col("t") < first), keys)


def _median(movie: DataFrame, keys: Sequence[str]) -> DataFrame:
    return movie.groupBy(*keys).agg(F.percentile("v", F.lit(0.5)).alias("v"))


def _extent(movie: DataFrame, keys: Sequence[str]) -> tuple[int, tuple[int, ...]]:
    """Frames and shape of a movie that starts at zero everywhere; zeros without rows."""
    n, *shape = movie.agg(*[F.coalesce(F.max(k) + 1, F.lit(0)) for k in ("t", *keys)]).first()
    return n, tuple(shape)


def rigid(movie: DataFrame, most: float = 15, upsample: int = 50, bin_frames: int = 200, first: int = 100, rounds: int = 1, whiten: bool = False, template: DataFrame | None = None, keys: Sequence[str] = PLANE):
    """(registered movie, shifts (t, shift), final template, first template); templates are images (keys, v), as is ``template`` if given.

    Pixels that a frame lacks count as the mean of the others, in it and in the template, and stay absent; a bin without frames keeps the template; an empty movie is returned as it is."""
    n, shape = _extent(movie, keys)
    if not n:
        empty = movie.select(*keys, "v")
        return movie, movie.select("t", F.array().cast("array<double>").alias("shift")), empty, empty
    movie, shifts, end, start = _rigid(movie, n, shape, most, upsample, bin_frames, first, rounds, whiten, template, keys)
    return movie, shifts, end.image(), start.image()


def _rigid(movie: DataFrame, n: int, shape: tuple[int, ...], most: float = 15, upsample: int = 50, bin_frames: int = 200, first: int = 100, rounds: int = 1, whiten: bool = False, template: DataFrame | None = None, keys: Sequence[str] = PLANE) -> tuple[DataFrame, DataFrame, Template, Template]:
    def move(ref: np.ndarray, frame: np.ndarray):
        s = reg.estimate_shift(ref, frame, upsample, most, whiten)
        return reg.apply_shift(frame, s), s

    start = now = pack(bootstrap_template(movie, first, keys) if template is None else template, shape, keys)
    shifts = None
    for _ in range(rounds):
        path = new_path(movie, "registered")
        for a in range(0, n, bin_frames):
            within = (F.col("t") >= a) & (F.col("t") < a + bin_frames)
            part = written(per_frame(movie.filter(within), now, move, (a, min(n, a + bin_frames))), "bin", f"{path}/bin={a // bin_frames}")
            after = pack(_median(part, keys), shape, keys)
            now = now if after.slabs.isEmpty() else after
        done = movie.sparkSession.read.schema(part.schema).parquet(path)
        own = done.filter("shift is not null").select("t", "shift")
        shifts = own if shifts is None else shifts.withColumnRenamed("shift", "__b").join(own, "t").select("t", F.zip_with("__b", "shift", lambda x, y: x + y).alias("shift"))
        movie = done.select(*keys, "t", "v")
    return movie, shifts, now, start


def piecewise(movie: DataFrame, grid: int = 32, deviation: float = 3, upsample: int = 50, whiten: bool = False, **options):
    """Rigid, then each frame by a smooth field of patch shifts."""
    n, shape = _extent(movie, PLANE)
    if not n:
        return rigid(movie)
    _, shifts, end, start = _rigid(movie, n, shape, upsample=upsample, whiten=whiten, **options)

    def move(ref: np.ndarray, frame: np.ndarray):
        base = reg.estimate_shift(ref, frame, upsample, options.get("most", 15), whiten)
        field = reg.shift_field(ref, frame, base, grid, deviation, upsample, whiten)
        return reg.displace(frame, reg.upsample_field(field, frame.shape)), base

    return per_frame(movie, end, move, (0, n)).drop("shift"), shifts, end.image(), start.image()


def affine_patches(movie: DataFrame, parts: int = 4, overlap: float = 0.1, iterations: int = 50, levels: int = 1, **options):
    """Rigid with a template of all frames, then an affine map for each patch of each frame."""
    from lumiframe.operators.patches import split_ranges

    n, (h, w) = _extent(movie, PLANE)
    if not n:
        return rigid(movie)
    moved, shifts, end, start = _rigid(movie, n, (h, w), **{**options, "first": n})
    cores = [(a, b) for a in split_ranges(h, parts, overlap) for b in split_ranges(w, parts, overlap)]

    def move(ref: np.ndarray, frame: np.ndarray):
        out = np.empty_like(frame)
        for (y0, y1, ry0, ry1), (x0, x1, rx0, rx1) in cores:
            part = frame[ry0:ry1, rx0:rx1]
            m, _ = reg.affine_ecc(ref[ry0:ry1, rx0:rx1], part, iterations, levels)
            y, x = np.mgrid[y0 - ry0 : y1 - ry0, x0 - rx0 : x1 - rx0].astype(float)
            out[y0:y1, x0:x1] = reg.bilinear(part, m[0, 0] * y + m[0, 1] * x + m[0, 2], m[1, 0] * y + m[1, 1] * x + m[1, 2])
        return out, np.zeros(2)

    return per_frame(moved, end, move, (0, n)).drop("shift"), shifts, end.image(), start.image()


def correct(movie: DataFrame, method: str = "rigid", **options):
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    return {"rigid": rigid, "patch": piecewise, "patchwarp": affine_patches}[method](movie, **options)


def low_signal_patches(template: DataFrame, grid: int, least: float = 0.1) -> DataFrame:
    """(py, px, low): patches of ``grid`` pixels whose deviation is under ``least`` times the whole image's."""
    whole = template.agg(F.stddev_pop("v").alias("__s"))
    per = template.groupBy(F.floor(F.col("y") / grid).cast("int").alias("py"), F.floor(F.col("x") / grid).cast("int").alias("px")).agg(F.stddev_pop("v").alias("s"))
    return per.crossJoin(F.broadcast(whole)).select("py", "px", (F.col("s") < least * F.col("__s")).alias("low"))


def integer_shift(movie: DataFrame, shifts: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Whole-pixel shifts (t, dy, dx) with repeated edges: every output pixel looks its source up by an equi-join."""
    h, w = shape
    src = movie.join(shifts, "t").withColumn("sy", F.least(F.greatest(F.col("y") - F.col("dy"), F.lit(0)), F.lit(h - 1))).withColumn("sx", F.least(F.greatest(F.col("x") - F.col("dx"), F.lit(0)), F.lit(w - 1)))
    own = movie.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "t", F.col("v").alias("__v"))
    return src.drop("v").join(own, ["sy", "sx", "t"]).select("y", "x", "t", F.col("__v").alias("v"))


def assess(before: DataFrame, after: DataFrame, start: DataFrame, end: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    """One row of motion metrics: correlations to the mean before and after, mean intensity difference, correlation of the two templates."""
    from lumiframe.operators import stats

    a = stats.correlation_to_reference(before, keys=keys).withColumnRenamed("correlation", "before")
    b = stats.correlation_to_reference(after, keys=keys).withColumnRenamed("correlation", "after")
    c = stats.max_intensity_difference(before, after, keys=keys)
    d = stats.image_correlation(start, end, keys).withColumnRenamed("correlation", "templates")
    return a.crossJoin(b).crossJoin(c).crossJoin(d)
