"""Closure of a pair table, for merging regions."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, made known to Spark as its checkpoint folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "lumiframe-checkpoints"))
    return sc.getCheckpointDir()


def _checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def closure(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50, node: str = "roi") -> DataFrame:
    """(node, group): group is the least node reachable over edges (a, b). Labels move along edges and jump to their label's label, so
    rounds grow with the logarithm of a chain's length; each round is a checkpoint."""
    both = _checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = _checkpoint(nodes.select(F.col(node).alias("n"), F.col(node).alias("g")))
    for _ in range(most_rounds):
        near = both.join(label, both["b"] == label["n"]).groupBy("a").agg(F.min("g").alias("m"))
        step = label.join(near, label["n"] == near["a"], "left").select("n", F.least("g", F.coalesce("m", "g")).alias("g"))
        up = step.select(F.col("n").alias("p"), F.col("g").alias("q"))
        new = _checkpoint(step.join(up, step["g"] == up["p"]).select("n", F.least("g", "q").alias("g")))
        changed = new.join(label.withColumnRenamed("g", "old"), "n").filter("g <> old").limit(1).count()
        label = new
        if not changed:
            return label.select(F.col("n").alias(node), F.col("g").alias("group"))
    raise RuntimeError(f"closure didn't settle in {most_rounds} rounds")
