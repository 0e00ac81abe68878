"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregates and two joins on node keys; a node of any degree is met by partial aggregation and by joins whose
large partitions the adaptive planner can split. No graph part is collected. Every round is a written table in the shared
folder, so a lost executor costs at most one round.

Before the first round and after each, every task brings its own edges down to a forest (``least_links``), so that the rounds meet no more edges of a
dense part than it has nodes in each task, however many links its nodes have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.llm.common import discard, materialize

#: Edges that a task holds at once.
BUFFER = 1 << 20


def least_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the given links: each node linked to the least of its component."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        m = np.minimum(label[x], label[y])
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        np.minimum.at(new, label[x], m)
        np.minimum.at(new, label[y], m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    up = label != np.arange(len(nodes))
    return nodes[up], nodes[label[up]]


def _within_tasks(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the same components, each task's brought down to a forest, ``BUFFER`` of them at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kind = [], 0, None

        def forest() -> tuple[np.ndarray, np.ndarray]:
            return least_links(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])

        for b in it:
            kind = b.column(0).type
            held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(2)))
            n += b.num_rows
            if n >= BUFFER:
                held = [forest()]
                n = len(held[0][0])
                if n >= BUFFER // 2:
                    yield batch(*held[0])
                    held, n = [], 0
        if n:
            yield batch(*forest())

    return edges.mapInArrow(run, edges.schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v) with u > v in; each node's neighbours (the larger ones, or the smaller ones and itself) linked to its least neighbour."""
    pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:  # m <= u < v
        return pairs.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge but roots: root is the least node that can be reached.

    Self-links, repeated and null edges add nothing; without edges the result is empty."""
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    cur = materialize(_within_tasks(cur), "edges")
    state = _state(cur)
    for _ in range(most_rounds):
        if not state[0]:
            break
        large = materialize(_star(cur, True), "edges")  # a small star reads it twice
        new = materialize(_within_tasks(_star(large, False)), "edges")
        discard(cur, large)
        cur, old = new, state
        state = _state(cur)
        if state == old:
            break
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
