"""Bounded previews, folder order and interleaved stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preview(movie: DataFrame, max_frames: int = 5000, max_voxels: int | None = None, voxels_per_frame: int | None = None) -> DataFrame:
    """The first frames, as a filter that reaches the scan; a voxel budget lowers the number of frames, to one at least."""
    n = max_frames
    if max_voxels is not None and voxels_per_frame:
        n = min(n, max(1, max_voxels // voxels_per_frame))
    return movie.filter(F.col("t") < n)


def deinterleave(slices: DataFrame, depth: int, index: str = "s", time: str = "t", plane: str = "d", whole: bool = True) -> DataFrame:
    """Slice s of an interleaved stack is plane s % depth of frame s div depth; an incomplete last frame is an error, or is kept as it is if not ``whole``."""
    n = (slices.agg(F.max(index) + 1).first()[0] or 0) if whole else 0
    if n % depth:
        raise ValueError(f"{n} slices don't make whole volumes of {depth}")
    return slices.withColumn(time, F.floor(F.col(index) / depth).cast("int")).withColumn(plane, (F.col(index) % depth).cast("int")).drop(index)
