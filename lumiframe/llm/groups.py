"""From links to groups: which row stands for each group, and tables without the others.

Rows are told apart by id and by a hash of their text, so that different texts under one id, and rows without an id, each have a
place. A group's first row is that of the least id (rows without one come last), of equal ids that of the least node, then of the
least text hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiframe.llm.common import discard, fresh, join_hot, light, materialize
from lumiframe.llm.components import components

#: Copies of a group's row, so that the nodes of one very large group meet it in several tasks.
SALTS = 32


def row_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def name_groups(rows: DataFrame, links: DataFrame, node: str = "fp") -> DataFrame:
    """``rows`` (written; doc_id, row, ``node``) with root, the least node of its group, and first, a struct (doc_id, node, row) of the row that stands for it.

    ``links`` (a, b) join nodes; a node without links is a group of its own."""
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", F.col(node).alias("node"), "row")
    each = rows.groupBy(node).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    up = components(links).select(F.col("node").alias(node), "root")
    up = materialize(up.union(up.select("root", "root").distinct()), "roots")
    each = materialize(each.join(up, node, "left"), "nodes")
    least = each.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int")
    linked = each.filter("root is not null").withColumn("salt", salt).join(least.withColumn("salt", salts), ["root", "salt"]).select(node, "root", F.col("least").alias("first"), "n")
    named = materialize(linked.union(each.filter("root is null").select(node, node, "first", "n")), "groups")
    discard(up, each)
    total = named.agg(F.sum("n")).first()[0] or 0
    return join_hot(rows, named, node, total)


def one_of_each(docs: DataFrame, named: DataFrame, node: str, doc_id: str, text: str) -> DataFrame:
    """``docs`` with one row of each group of ``named`` (``name_groups``): its first. Of rows equal in id and text the one with the least hash of all columns stays. Columns are untouched."""
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col(node) == F.col("first.node")) & (F.col("row") == F.col("first.row"))
    named = materialize(named.select("doc_id", "row", stays.alias("stays")), "decided")
    pick = [fresh(docs, "__gone_id"), fresh(docs, "__gone_row")]
    at = lambda df: df.select(F.col("doc_id").alias(pick[0]), F.col("row").alias(pick[1]))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(pick[0])) & (row_hash(f"`{text}`") == F.col(pick[1]))
    gone = materialize(at(named.filter(~F.col("stays"))).distinct(), "gone")
    kept = docs.join(light(gone, F.coalesce(F.length(F.col(pick[0]).cast("string")), F.lit(0)) + 48), same, "left_anti")
    again = materialize(at(named.filter("stays").groupBy("doc_id", "row").count().filter("count > 1")), "again")
    discard(named)
    if again.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    one = docs.join(again, same).groupBy(*pick).agg(F.min_by(whole, order).alias("w")).select("w.*")
    return kept.join(again, same, "left_anti").unionByName(one)
