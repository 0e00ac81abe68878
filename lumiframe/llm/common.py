"""Shared helpers: reading tables, shared-folder tables, and Arrow batch plumbing."""

from __future__ import annotations

import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table scan with fewer partitions than there are cores (a few small files), dealt out anew so that all cores take part; others as they are.

    For scans only: the number of partitions of a plan with shuffles isn't known before it runs."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset, and gets a temporary one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "lumiframe-checkpoints")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The table goes with ``discard``, or when the driver ends."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumiframe_path = path
    return out


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody uses; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/lumiframe/{label}-{uuid.uuid4().hex}"
    fs, p = _file(spark, path)
    fs.deleteOnExit(p)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these."""
    for df in tables:
        if path := getattr(df, "_lumiframe_path", None):
            fs, p = _file(df.sparkSession, path)
            fs.delete(p, True)


#: A key of more than this share of all rows is hot; fewer keys than its inverse can be.
HOT_SHARE = 1 / 1000


def join_hot(rows: DataFrame, named: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``named`` (one row a key, written; column ``n``: how many of ``rows`` hold it; ``total``: all of them).

    Hot keys, fewer than a thousand whatever the input, are broadcast, so none of them meets in one task; the others are shuffled."""
    hot = named.filter(F.col(n) > max(1, total * HOT_SHARE))
    if hot.isEmpty():
        return rows.join(named, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named.filter(F.col(n) <= max(1, total * HOT_SHARE)), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


#: Bytes of a table that may be sent to every executor.
LIGHT = 32 << 20


def light(df: DataFrame, size: Column) -> DataFrame:
    """``df`` (written), marked for broadcast if its rows' ``size``, in bytes, come to at most ``LIGHT``; a heavier one is joined by shuffles."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= LIGHT else df


def held_out(key: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(it: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose ``column`` holds about ``most_bytes`` of text, or a single longer text."""
    for b in it:
        col = b.column(b.schema.get_field_index(column))
        sizes = pc.binary_length(col).fill_null(0).to_pylist()
        at, held = 0, 0
        for k, n in enumerate(sizes):
            if k > at and held + n > most_bytes:
                yield b.slice(at, k - at)
                at, held = k, 0
            held += n
        if b.num_rows > at:
            yield b.slice(at, b.num_rows - at)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    return next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count())) if n.lower() not in have)


def filter_rows(df: DataFrame, text: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``df`` for which ``keep`` (a list of texts to a list of flags) holds; no shuffle, columns untouched."""
    at = df.columns.index(text)

    def run(it):
        for b in it:
            if b.num_rows:
                flags = []
                for part in text_batches([b], b.schema.names[at]):
                    flags += keep(part.column(at).to_pylist())
                yield b.filter(pa.array(flags, pa.bool_()))

    return df.mapInArrow(run, T.StructType(df.schema.fields))
