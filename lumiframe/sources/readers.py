"""Movies and volumes from files in any store that Spark reads. Files go through ``binaryFile``, so paths are Spark's, listing is
distributed, and every file is decoded in the task that reads it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiframe.sources import formats, hdf5

LONG, VOLUME = "y int, x int, t int, v double", "l int, w int, d int, t int, v double"
SUFFIXES = (".npy", ".tif", ".tiff", ".fits", ".fit", ".mat", ".h5", ".hdf5")


def _rows(a: np.ndarray, names: list[str], chunk: int = 1 << 18, **fixed: int) -> Iterator[pd.DataFrame]:
    """Long rows of an array, in bounded pieces."""
    for k in range(0, a.size, chunk):
        at = np.unravel_index(np.arange(k, min(k + chunk, a.size)), a.shape)
        yield pd.DataFrame({**{n: i.astype("int32") for n, i in zip(names, at, strict=True)}, **{n: np.int32(v) for n, v in fixed.items()}, "v": np.asarray(a[at], float)})


def _decode(files: DataFrame, decode, names: list[str], schema: str) -> DataFrame:
    def run(it):
        for p in it:
            for raw in p["content"]:
                yield from (q[[c.split()[0] for c in schema.split(", ")]] for q in _rows(decode(bytes(raw)), names))

    return files.select("content").mapInPandas(run, schema)


def read_movie(spark: SparkSession, path: str) -> DataFrame:
    """A movie by the kind of its file: ``.npy`` (rows, columns, frames), ``.tif``/``.tiff`` (frames, rows, columns), ``.fits``, ``.h5``/``.hdf5`` and ``.mat`` (versions 5 and 7.3; the largest array: rows, columns, frames); a path without a suffix is a folder of TIFF files, one frame each."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = "." + name.rsplit(".", 1)[-1] if "." in name else ""
    if not suffix:
        return read_tiff_folder(spark, path)
    if suffix not in SUFFIXES:
        raise ValueError(f"unknown kind of movie file: {suffix}")
    if suffix in (".h5", ".hdf5") or suffix == ".mat" and hdf5.is_hdf5(path):
        return hdf5.read_movie(spark, path, ["y", "x", "t"], matlab=suffix == ".mat")
    files = spark.read.format("binaryFile").load(path)
    if suffix == ".npy":
        return _decode(files, _plane(formats.read_npy), ["y", "x", "t"], LONG)
    if suffix in (".tif", ".tiff"):
        return _decode(files, formats.read_tiff, ["t", "y", "x"], LONG)
    if suffix == ".mat":
        return _decode(files, _plane(lambda raw: formats.largest_variable(formats.read_mat(raw))), ["y", "x", "t"], LONG)
    return _decode(files, _plane(formats.read_fits), ["y", "x", "t"], LONG)


def _plane(read):
    def run(raw: bytes) -> np.ndarray:
        a = read(raw)
        if a.ndim != 3:
            raise ValueError(f"a movie has 3 axes, this file has {a.ndim}")
        return a

    return run


def read_tiff_folder(spark: SparkSession, path: str) -> DataFrame:
    """Sorted ``.tif`` files, then sorted ``.tiff`` files; each is one frame."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").load(path)
    order = ordinal(files.select("path"))
    held = files.join(F.broadcast(order) if order.count() < 100_000 else order, "path")

    def run(it):
        for p in it:
            for raw, t in zip(p["content"], p["t"], strict=True):
                for q in _rows(formats.read_tiff(bytes(raw))[0], ["y", "x"], t=int(t)):
                    yield q[["y", "x", "t", "v"]]

    return held.select("content", "t").mapInPandas(run, LONG)


def ordinal(paths: DataFrame, name: str = "t") -> DataFrame:
    """(path, t): the place of each file in the folder's order. One row a file."""
    w = Window.orderBy(F.lower("path").endswith(".tiff"), "path")
    return paths.select("path", (F.row_number().over(w) - 1).cast("int").alias(name))


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """A FITS file of four axes (t, l, w, d)."""
    return _decode(spark.read.format("binaryFile").load(path), lambda raw: formats.read_fits(raw, 4), ["t", "l", "w", "d"], VOLUME)


def read_volume_folder(spark: SparkSession, path: str, mode: str = "one_volume_per_stack", depth: int | None = None) -> DataFrame:
    """A folder of TIFF stacks: each a volume (its pages are d), or all of them one long run of slices, ``depth`` to a volume."""
    if mode not in ("one_volume_per_stack", "interleaved"):
        raise ValueError("mode must be one_volume_per_stack or interleaved")
    if mode == "interleaved" and not depth:
        raise ValueError("interleaved stacks need a depth")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").load(path)
    sizes = files.select("path", F.udf(lambda raw: list(formats.read_tiff(bytes(raw)).shape), "array<int>")("content").alias("shape"))
    sizes = sizes.join(ordinal(files.select("path"), "f"), "path").orderBy("f").select("path", "f", "shape").collect()
    if len({tuple(r["shape"][1:]) for r in sizes}) > 1 or mode != "interleaved" and len({tuple(r["shape"]) for r in sizes}) > 1:
        raise ValueError("the stacks differ in shape")
    first = dict(zip([r["path"] for r in sizes], np.cumsum([0, *[r["shape"][0] for r in sizes]]).tolist(), strict=False))
    total = sum(r["shape"][0] for r in sizes)
    if mode == "interleaved" and total % depth:
        raise ValueError(f"{total} slices don't make whole volumes of {depth}")
    place = {r["path"]: r["f"] for r in sizes}

    def run(it):
        for p in it:
            for where, raw in zip(p["path"], p["content"], strict=True):
                for k, page in enumerate(formats.read_tiff(bytes(raw))):
                    s = first[where] + k
                    t, d = divmod(s, depth) if mode == "interleaved" else (place[where], k)
                    for q in _rows(page, ["l", "w"], d=d, t=t):
                        yield q[["l", "w", "d", "t", "v"]]

    return files.select("path", "content").mapInPandas(run, VOLUME)


def write_frames(movie: DataFrame, path: str) -> None:
    """A movie as Parquet, frames in order within files, so that a frame limit skips row groups."""
    movie.repartitionByRange("t").sortWithinPartitions("t").write.mode("overwrite").parquet(path)


def describe(spark: SparkSession, path: str) -> str:
    """``3 files, 1.25 MB``."""
    r = spark.read.format("binaryFile").load(path).select("length").agg(F.count(F.lit(1)), F.sum("length")).first()
    return f"{r[0]} file{'' if r[0] == 1 else 's'}, {(r[1] or 0) / 1e6:.2f} MB"


def summary(movie: DataFrame, keys=("y", "x")) -> str:
    """``32 x 64 pixels, 100 frames``."""
    r = movie.agg(*[(F.max(k) + 1).alias(k) for k in keys], (F.max("t") + 1).alias("t")).first()
    return f"{' x '.join(str(r[k]) for k in keys)} {'voxels' if len(keys) == 3 else 'pixels'}, {r['t']} frames"


#: A NaN of its own bits marks pixels without a row; other readers see a blank pixel.
ABSENT = np.uint32(0x7FC0ABE5)


def encode_frames(movie: DataFrame, kind: str = "fits") -> DataFrame:
    """(t, content): each frame as the bytes of a FITS or TIFF file of 32-bit floats, for any sink that takes bytes. Pixels without a row are NaN and stay without one."""
    if kind not in ("fits", "tiff"):
        raise ValueError("kind must be fits or tiff")
    write = formats.write_fits if kind == "fits" else formats.write_tiff

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(p["y"].max()) + 1, int(p["x"].max()) + 1), ABSENT).view(np.float32)
        a[p["y"], p["x"]] = p["v"]
        return pd.DataFrame({"t": [int(p["t"].iloc[0])], "content": [write(a)]})

    return movie.groupBy("t").applyInPandas(run, "t int, content binary")


def decode_frames(frames: DataFrame, kind: str = "fits") -> DataFrame:
    read = formats.read_fits if kind == "fits" else lambda raw: formats.read_tiff(raw)[0]

    def run(it):
        for p in it:
            for t, raw in zip(p["t"], p["content"], strict=True):
                a = read(bytes(raw))
                there = np.ones(a.shape, bool) if a.dtype.itemsize != 4 else np.ascontiguousarray(a, a.dtype.newbyteorder("=")).view(np.uint32) != ABSENT
                for k in range(0, a.size, 1 << 18):
                    at = np.unravel_index(np.arange(k, min(k + (1 << 18), a.size)), a.shape)
                    at = tuple(i[there[at]] for i in at)
                    yield pd.DataFrame({"y": at[0].astype("int32"), "x": at[1].astype("int32"), "t": np.int32(t), "v": a[at].astype(float)})

    return frames.mapInPandas(run, LONG)
