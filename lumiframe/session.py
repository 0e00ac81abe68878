"""Sessions, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python workers this package, once for each application; for runs that weren't submitted with --py-files."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="lumiframe-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"lumiframe/{p.relative_to(root)}")
        sc.addPyFile(path)
    return spark


#: Bytes of a batch that goes to a Python worker or comes back; Spark's own bounds (10,000 rows, 64 MB) hold some 30 MB of texts on both sides of each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    """Bounds the Arrow batches of this session's Python functions by bytes; a smaller bound that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= most_bytes:
        spark.conf.set(key, str(most_bytes))


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects; on a cluster, pass these to spark-submit instead."""
    b = SparkSession.builder.master(master).appName("lumiframe")
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return ship(b.getOrCreate())
