"""Images that tasks need whole, kept as written tables: the templates of motion correction.

An image is a table of slabs: some rows of its first axis, packed to eight-byte floats. Frames get it in one of two ways, by its size: one of at most
``LIGHT_BYTES`` is broadcast; a heavier one is sent to the frames by their own shuffle and never passes the driver. A task holds one
frame and one image, whatever the length of the movie.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.operators.graph import shared_folder

#: Bytes of an image that may pass the driver, and of one slab.
LIGHT_BYTES, SLAB_BYTES = 32 << 20, 8 << 20


def new_path(df: DataFrame, label: str) -> str:
    """A path in the shared folder that nobody uses; what is written there goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    return path


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its plan is cut, and a lost executor costs nothing."""
    path = path or new_path(df, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Template:
    """An image of ``shape`` over ``keys``. ``slabs``: (lo, block), the first row of each slab and its values."""

    slabs: DataFrame
    shape: tuple[int, ...]
    keys: tuple[str, ...]

    @property
    def light(self) -> bool:
        return 8 * math.prod(self.shape) <= LIGHT_BYTES

    def image(self) -> DataFrame:
        """(keys, v) of every pixel."""
        rest, names = self.shape[1:], [*self.keys, "v"]

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for lo, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    v = np.frombuffer(block).reshape(-1, *rest)
                    at = np.indices(v.shape, np.int32)
                    at[0] += lo
                    cols = [*(a.ravel() for a in at), v.ravel()]
                    for k in range(0, v.size, 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in cols], names=names)

        return self.slabs.mapInArrow(run, ", ".join(f"{k} int" for k in self.keys) + ", v double")


def _whole(slabs, shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(shape)
    for lo, block in slabs:
        part = np.frombuffer(block).reshape(-1, *shape[1:])
        out[lo : lo + len(part)] = part
    return out


def pack(image: DataFrame, shape: Sequence[int], keys: Sequence[str]) -> Template:
    """The image (keys, v) as a written template; pixels without a row are zero."""
    keys, shape = tuple(keys), tuple(shape)
    rows = max(1, SLAB_BYTES // (8 * math.prod(shape[1:])))

    def run(key, t):
        lo = key[0].as_py() * rows
        block = np.zeros((min(rows, shape[0] - lo), *shape[1:]))
        at = [t.column(k).to_numpy() for k in keys]
        block[(at[0] - lo, *at[1:])] = t.column("v").to_numpy()
        return pa.table({"lo": pa.array([lo], pa.int32()), "block": pa.array([block.tobytes()], pa.binary())})

    slab = F.floor(F.col(keys[0]) / rows).cast("int")
    return Template(written(image.select(*keys, F.col("v").cast("double").alias("v"), slab.alias("__slab")).groupBy("__slab").applyInArrow(run, "lo int, block binary"), "template"), shape, keys)


def per_frame(movie: DataFrame, template: Template, move: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], frames: tuple[int, int]) -> DataFrame:
    """``move(template, frame) -> (frame, shift)`` for every frame of a movie of the template's shape: (keys, t, v, shift) of each of its rows, with the
    frame's shift on the first of its rows alone and null on the others. Places without a row in the frame get each image's mean over the others, so that
    their edges, which don't move, hold no frame fast. ``frames``: the first frame and the one after the last."""
    keys, shape = template.keys, template.shape

    def moved(ref: np.ndarray, t: pa.Table) -> pa.Table:
        at = tuple(t.column(k).to_numpy() for k in keys)
        frame = np.zeros(shape)
        frame[at] = t.column("v").to_numpy()
        if t.num_rows < frame.size:
            there = np.zeros(shape, bool)
            there[at] = True
            frame, ref = (np.where(there, a, a[there].mean()) for a in (frame, ref))
        out, shift = move(ref, frame)
        kind = pa.list_(pa.float64())
        shifts = pa.chunked_array([pa.array([shift.tolist()], kind), pa.nulls(t.num_rows - 1, kind)])
        return pa.table([*(t.column(k) for k in (*keys, "t")), pa.array(out[at]), shifts], names=[*keys, "t", "v", "shift"])

    rows = movie.select(*[F.col(k).cast("int").alias(k) for k in (*keys, "t")], F.col("v").cast("double").alias("v"))
    out = ", ".join(f"{k} int" for k in (*keys, "t")) + ", v double, shift array<double>"
    if template.light:
        held = movie.sparkSession.sparkContext.broadcast(_whole(template.slabs.collect(), shape))
        return rows.groupBy("t").applyInArrow(lambda t: moved(held.value, t), out)
    sent = template.slabs.select(F.explode(F.sequence(F.lit(frames[0]), F.lit(frames[1] - 1))).alias("t"), "lo", "block")

    def both(t, slabs):
        if not t.num_rows:  # a frame without rows
            return moved_schema.empty_table()
        return moved(_whole(zip(slabs.column("lo").to_pylist(), slabs.column("block").to_pylist(), strict=True), shape), t)

    moved_schema = pa.schema([*((k, pa.int32()) for k in (*keys, "t")), ("v", pa.float64()), ("shift", pa.list_(pa.float64()))])
    return rows.groupBy("t").cogroup(sent.groupBy("t")).applyInArrow(both, out)
