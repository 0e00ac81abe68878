"""Movies as relations, and the conversions between their three physical forms.

long:  (spatial keys..., t INT, v DOUBLE), the canonical form;
trace: (spatial keys..., trace ARRAY<DOUBLE>) ordered by t, for per-pixel time algorithms;
frame: (t, frame ARRAY<DOUBLE>) row-major, for per-frame space algorithms.

Every operator takes its spatial keys as an argument, so planes (y, x) and volumes (l, w, d) share one implementation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLANE = ("y", "x")
VOLUME = ("l", "w", "d")
EPOCH_2024 = 1_704_067_200
FRAME_SECONDS = 21_600
EVT_FRAMES = 120


def validate(df: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    """``df`` with its columns cast to the long form's types; an error names what is missing."""
    missing = [c for c in (*keys, "t", "v") if c not in df.columns]
    if missing:
        raise ValueError(f"not a movie: no column {', '.join(missing)}")
    return df.select(*[F.col(k).cast("int").alias(k) for k in keys], F.col("t").cast("int").alias("t"), F.col("v").cast("double").alias("v"))


def to_trace(df: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    """One shuffle; each pixel's samples in time order."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"))
    return packed.select(*keys, F.transform("p", lambda s: s["v"]).alias("trace"))


def from_trace(df: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    return df.select(*keys, F.posexplode("trace").alias("t", "v"))


def to_frame(df: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    packed = df.groupBy("t").agg(F.array_sort(F.collect_list(F.struct(*keys, "v"))).alias("p"))
    return packed.select("t", F.transform("p", lambda s: s["v"]).alias("frame"))


def from_frame(df: DataFrame, width: int) -> DataFrame:
    e = df.select("t", F.posexplode("frame").alias("i", "v"))
    return e.select(F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "t", "v")


def from_array(spark: SparkSession, movie, keys: Sequence[str] = PLANE) -> DataFrame:
    """A numpy movie with time last, as a long relation."""
    import numpy as np
    import pandas as pd

    grid = np.indices(movie.shape)
    cols = {k: grid[i].ravel().astype("int32") for i, k in enumerate((*keys, "t"))}
    return spark.createDataFrame(pd.DataFrame({**cols, "v": np.asarray(movie, float).ravel()}))


def to_array(df: DataFrame, keys: Sequence[str] = PLANE):
    """A small movie or image back as numpy; for tests and single patches."""
    import numpy as np

    axes = [*keys, *(["t"] if "t" in df.columns else [])]
    p = df.select(*axes, "v").toPandas()
    out = np.full(tuple(int(p[a].max()) + 1 for a in axes), np.nan)
    out[tuple(p[a].to_numpy() for a in axes)] = p["v"]
    return out


def embedding_movie(spark: SparkSession, sf_dir: str, width: int = 25) -> DataFrame:
    """``embeddings`` as a movie: one pixel for each vector, one frame for each component."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("t", "v"))
    return e.select(F.floor(F.col("vec_id") / width).cast("int").alias("y"), (F.col("vec_id") % width).cast("int").alias("x"), "t", F.col("v").cast("double").alias("v"))


def embedding_labels(spark: SparkSession, sf_dir: str, width: int = 25) -> DataFrame:
    """ROI pixels of the embedding movie: (roi, y, x), one ROI for each label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("label").cast("int").alias("roi"), F.floor(F.col("vec_id") / width).cast("int").alias("y"), (F.col("vec_id") % width).cast("int").alias("x"))


def embedding_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors as a volume (l, w, d) over time."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("t", "v"))
    v = F.col("vec_id")
    return e.select(F.floor(v / 100).cast("int").alias("l"), (F.floor(v / 10) % 10).cast("int").alias("w"), (v % 10).cast("int").alias("d"), "t", F.col("v").cast("double").alias("v"))


def event_movie(spark: SparkSession, sf_dir: str, width: int = 10, frames: int = EVT_FRAMES) -> DataFrame:
    """``events`` as a movie: one pixel for each user, six-hour frames, sums of values on the dense grid."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", frame_of("ts").alias("t"), "value")
    own = e.groupBy("user_id", "t").agg(F.sum("value").alias("v"))
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("t"))
    m = grid.join(own, ["user_id", "t"], "left")
    return m.select(F.floor(F.col("user_id") / width).cast("int").alias("y"), (F.col("user_id") % width).cast("int").alias("x"), "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def frame_of(ts: str, seconds: int = FRAME_SECONDS):
    return F.floor((F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6) - EPOCH_2024) / seconds).cast("int")


def event_traces(spark: SparkSession, sf_dir: str, frames: int = 720) -> DataFrame:
    """(id, t, v): hourly sums of values for each event type, on the dense grid."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("id"), frame_of("ts", 3600).alias("t"), "value")
    own = e.groupBy("id", "t").agg(F.sum("value").alias("v"))
    grid = e.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("t"))
    return grid.join(own, ["id", "t"], "left").select("id", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def order_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, v): total price of the orders of each day, t the day's rank."""
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    # one row a day: the single-partition window is bounded by the calendar
    return o.select((F.row_number().over(Window.orderBy("day")) - 1).alias("t"), "v")


MOVIE = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("v", T.DoubleType())])
