"""Near-duplicates by SimHash, completed to all pairs of Jaccard similarity 0.8 of word shingles.

Ball hashing within 4 bits (``simhash.links``) meets the closest texts, large groups of copies above all. It misses most pairs of similarity 0.8 to 0.92,
which differ in 5 to 13 bits, so the orders of min-hashes (``forest.links``) complete it. Every link of either kind is confirmed on the
exact sets of shingles, five words each. Equal sets are one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.llm import forest, simhash
from lumiframe.llm.common import discard, materialize
from lumiframe.llm.groups import name_groups, one_of_each

PERCENT, SHINGLE = 80, 5


def suggested(sets: DataFrame) -> DataFrame:
    """(a, b) pairs of set keys, written, whose fingerprints SimHash links or that have one fingerprint: each fingerprint's least key stands for it."""
    near = simhash.links(sets.filter("n > 0").select("fp").distinct())
    of_fp = sets.filter("n > 0").groupBy("fp").agg(F.min("key").alias("key"))
    side = lambda f, k: of_fp.select(F.col("fp").alias(f), F.col("key").alias(k))
    across = near.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    within = sets.filter("n > 0").select("fp", F.col("key").alias("y")).distinct().join(side("fp", "x"), "fp").filter("x <> y").select("x", "y")
    out = materialize(across.union(within).select(F.col("x").alias("a"), F.col("y").alias("b")), "suggested")
    discard(near)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, key, root, first) of each row, see ``groups.name_groups``: key is its set's hash, root the least key of its component.

    Null and wordless texts have one set, the empty one; repeated rows each get a row; an empty table gives none."""
    sets = forest.sketch(docs, doc_id, text, shingle)
    first = suggested(sets)
    edges = forest.links(sets, docs, first, doc_id, text, percent, shingle)
    discard(first)
    return name_groups(sets.select("doc_id", "row", "key"), edges, "key")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id; of different texts under that id the one with the least
    set key, then the least text hash. Rows without an id stand for a component only if it has no other; of rows equal in id and text one
    stays. Null and wordless texts are one component. Columns are untouched; an empty table stays empty."""
    return one_of_each(docs, near_duplicates(docs, doc_id, text, percent, shingle), "key", doc_id, text)
