"""Near-duplicates of Jaccard similarity by an LSH forest of min-hash orders.

A document is its set of distinct shingles, as 64-bit hashes; equal sets are one node, named by a hash of the set. Each of ``TREES`` trees puts all
nodes into the order of a signature of min-hashes. Nodes that agree on a tree's first ``LEVELS`` hashes are a region; two sets of similarity 0.8
meet in none of the regions with probability 3e-6. How deep a region is read depends on how many nodes it has:

* up to ``MOST``: all of its nodes are candidates of each other; pairs of unlike size or estimated similarity (five deviations below the threshold) go.
* more: it is read in the order of the deeper hashes, so a node's candidates are the neighbours with the longest common prefix in each order; the
  two likeliest are tried. That links most of a large group of copies, with few pairs a node, however large it is.

What the deeper order parts is found exactly: large regions that still have several groups are gathered to clusters (nodes that share such a region). A
cluster's nodes are dealt to blocks, each pair of which is one task's group of bounded bytes, where pairs are looked up by their rarest shingles (two sets of
similarity s share one of the rarest ``1 - s`` of each) and compared on whole sets, unless they are linked already. Links alone are
written, at most as many as a block has nodes. A node is dealt to ``SPREAD`` blocks or fewer while its cluster has less than ``SPREAD`` times ``BLOCK_BYTES``.
Each link of any kind is confirmed on full sets. No node has a cap on partners. Candidates that pairs join to a group of at most ``MEET_BYTES`` are sent once,
to their group; in a larger one the set of each pair's second node is sent to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm import simhash
from lumiframe.llm.common import discard, light, materialize, partitions, spread, table, text_batches
from lumiframe.llm.components import components
from lumiframe.llm.groups import name_groups, row_hash

PERCENT, SHINGLE = 80, 4
TREES, LEVELS = 24, 4
#: Nodes of a region whose pairs are all tried.
MOST = 64
#: Bytes of hashes in a block of a cluster, nodes from which a cluster has several blocks, and blocks until bytes alone decide.
BLOCK_BYTES, BLOCK_NODES, SPREAD = 16 << 20, 1024, 8
#: Bytes of hashes of candidates that pairs join, up to which these meet in one group, each set sent once.
MEET_BYTES = 1 << 20
#: Estimates so far below the threshold go: five deviations of TREES * LEVELS draws.
SLACK = 0.2
_HASHES = TREES * LEVELS
_RANDOM = np.random.default_rng(20_262).integers(0, 1 << 32, (2, _HASHES), np.uint64).astype(np.uint32)
_XOR, _MULTIPLY = _RANDOM[0], _RANDOM[1] | np.uint32(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles, as ``simhash.shingle_hashes`` has them."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def set_key(h: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(h.tobytes(), 42)).view(np.int64))


def signature(h: np.ndarray) -> np.ndarray:
    """The least value of each of the forest's hash functions over a set."""
    least = np.full(_HASHES, np.iinfo(np.uint32).max, np.uint32)
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    for k in range(0, len(low), 256):
        np.minimum(least, ((low[k : k + 256, None] ^ _XOR) * _MULTIPLY).min(0), out=least)
    return least


def regions(sig: np.ndarray) -> list[int]:
    """A key for each tree's first hashes."""
    from xxhash import xxh64_intdigest

    raw, n = sig.tobytes(), 4 * LEVELS
    return [xxh64_intdigest(raw[n * t : n * t + n], t) for t in range(TREES)]


def similar(met: np.ndarray, n: np.ndarray, m: int, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` elements with ``met`` in common are similar, in whole numbers."""
    return 100 * met >= percent * (n + m - met)


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp, key, n, regions, sig) of every row, written: a hash of its text, its SimHash, and of its set a hash, the size, the regions and the
    low halves of its signature.

    Null and wordless texts have the empty set; repeated rows each get a row; an empty table gives none; other columns are ignored."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(it, "text"):
            every = [simhash.shingle_hashes(t, shingle) for t in b.column(2).to_pylist()]
            fps = np.array([simhash.majority(h) for h in every], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in every]
            sigs = [signature(h) for h in sets]
            near = [np.array(regions(s), np.uint64).view(np.int64) if len(h) else [] for s, h in zip(sigs, sets, strict=True)]
            cols = [pa.array(fps), pa.array([set_key(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()), pa.array(near, pa.list_(pa.int64())), pa.array([s.astype("<u2").tobytes() for s in sigs], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols], names=["doc_id", "row", "fp", "key", "n", "regions", "sig"])

    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_hash(f"`{text}`").alias("row"), F.col(f"`{text}`").alias("text"))
    return materialize(src.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, row long, fp long, key long, n int, regions array<long>, sig binary"), "sets")


def _sig(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(b.schema.get_field_index("sig")).to_pylist()), "<u2").reshape(b.num_rows, _HASHES)


def _small(percent: int):
    """Streams rows (h, key, n, sig) sorted by h: the likely pairs (a, b) of each region."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def pairs(key: np.ndarray, n: np.ndarray, sig: np.ndarray) -> np.ndarray:
            like = (sig[:, None] == sig[None]).mean(2) >= percent / 100 - SLACK
            like &= 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
            a, b = np.nonzero(np.triu(like, 1))
            return np.stack((np.minimum(key[a], key[b]), np.maximum(key[a], key[b])), 1)

        def flush(h, key, n, sig) -> pa.RecordBatch:
            edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            out = [pairs(key[i:j], n[i:j], sig[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            found = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for b in it:
            if not b.num_rows:
                continue
            new = [*(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)), _sig(b)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            whole = int(np.searchsorted(held[0], held[0][-1], "left"))
            if whole:
                yield flush(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held:
            yield flush(*held)

    return run


def _neighbours(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows (h, key, n, sig) in the order of a region's deeper hashes: (key, other, like) of every two that stand side by side, both ways."""
    last = None
    for b in it:
        if not b.num_rows:
            continue
        h, key = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        sig = _sig(b)
        if last:
            h, key, sig = np.append(last[0], h), np.append(last[1], key), np.concatenate((last[2], sig))
        last = h[-1:], key[-1:], sig[-1:]
        at = np.flatnonzero(h[1:] == h[:-1])
        like = (sig[at] == sig[at + 1]).sum(1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((key[at], key[at + 1]), (key[at + 1], key[at]), (like, like))], names=["key", "other", "like"])


def _confirm(percent: int):
    """Streams rows (a, b, h) sorted by a, b, whose first of each a has no b and holds its own set: the similar pairs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.int64)
        for batch in text_batches(it, "h"):
            a, b = (batch.column(k).to_pylist() for k in range(2))
            keep = []
            for k, raw in enumerate(batch.column(2)):
                h = np.frombuffer(raw.as_py(), np.int64)
                if b[k] is None:
                    hub, own = a[k], h
                keep.append(b[k] is not None and hub == a[k] and bool(similar(len(np.intersect1d(own, h, assume_unique=True)), len(h), len(own), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _meet(percent: int):
    """Streams rows (group, a, b, h) sorted by group, b: the sets of a group's nodes a, which have no b, then its pairs (a, b): the similar pairs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, {}
        for batch in it:
            g, a, b, h = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for k in range(len(g)):
                if g[k] != group:
                    group, own = g[k], {}
                if b[k] is None:
                    own[a[k]] = np.frombuffer(h[k], np.int64)
                    keep.append(False)
                else:
                    x, y = own[a[k]], own[b[k]]
                    keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sets_of(keys: DataFrame, docs: DataFrame, holder: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(key, h) of the given keys, written: h has the set's hashes in order, eight bytes each. ``holder``: (key, doc_id, row) of a row for each key."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(it, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, shingle).view(np.int64).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["key", "h"])

    keys = materialize(keys.join(holder, "key").select("key", F.col("doc_id").alias("k_id"), F.col("row").alias("k_row")), "holders")
    keys = light(keys, F.coalesce(F.length(F.col("k_id").cast("string")), F.lit(0)) + 56)
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), row_hash(f"`{text}`").alias("row"), F.col(f"`{text}`").alias("text"))
    found = src.join(keys, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("row") == F.col("k_row"))).select("key", "text")
    out = materialize(found.mapInArrow(run, "key long, h binary"), "sets")
    if out.groupBy("key").count().filter("count > 1").isEmpty():
        return out
    once = materialize(out.groupBy("key").agg(F.first("h").alias("h")), "sets")  # rows equal in id and text
    discard(out)
    return once


def confirmed(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, meet_bytes: int = MEET_BYTES) -> DataFrame:
    """The pairs (a, b; written) whose sets are similar, written. ``sizes``: (key, n) of every node."""
    up = components(pairs)
    up = materialize(up.union(up.select("root", "root").distinct()).select(F.col("node").alias("key"), "root"), "met")
    label = materialize(sizes.join(light(up, F.lit(24)), "key").select("key", "root", "n"), "met")
    discard(up)
    large = label.groupBy("root").agg((8 * F.sum("n")).alias("bytes")).filter(F.col("bytes") > meet_bytes).select("root")
    large = light(materialize(large, "large"), F.lit(16))
    few = light(materialize(label.join(large, "root", "left_anti").select("key", F.col("root").alias("group")), "few"), F.lit(24))
    nodes = sets.join(few, "key").select("group", F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "h")
    among = pairs.join(few.withColumnRenamed("key", "a"), "a").select("group", "a", "b", F.lit(None).cast("binary").alias("h"))
    dealt = nodes.union(among).repartition(partitions(pairs.sparkSession), "group").sortWithinPartitions("group", F.col("b").asc_nulls_first())
    found = dealt.mapInArrow(_meet(percent), "a long, b long")
    if not large.isEmpty():
        crowd = light(materialize(label.join(large, "root").select("key"), "crowd"), F.lit(16))
        found = found.union(_by_hubs(pairs.join(crowd.withColumnRenamed("key", "a"), "a"), sets.join(crowd, "key"), percent))
    return materialize(found, "similar")


def _by_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: the set of each b is sent to its a."""
    with_b = pairs.join(sets.select(F.col("key").alias("b"), "h"), "b").select("a", "b", "h")
    with_a = sets.join(pairs.select(F.col("a").alias("key")).distinct(), "key").select(F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "h")
    dealt = with_a.union(with_b).repartition(partitions(pairs.sparkSession), "a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_confirm(percent), "a long, b long")


def compare(keys: np.ndarray, sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (keys) among similar sets of different labels that join all similar ones; between both sides if there are two, else within the one."""
    order = np.argsort([len(h) for h in sets], kind="stable")
    n = np.array([len(sets[k]) for k in order])
    keys, side, label = keys[order], side[order], label[order].copy()
    two = side[0] != side[-1] or bool((side != side[0]).any())
    _, ids, often = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    starts = np.concatenate(([0], np.cumsum(n)))
    rank = np.argsort(np.argsort(often, kind="stable"))  # the rarest shingles first, in one order for all
    prefix = [np.sort(rank[ids[i:j]])[: j - i + (-percent * (j - i) // 100) + 1] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    owner = np.repeat(np.arange(len(n)), [len(p) for p in prefix])
    posted = np.concatenate(prefix)
    by_rank = np.lexsort((owner, posted))
    posted, owner = posted[by_rank], owner[by_rank]
    seen, links = np.zeros(len(often), bool), []
    for i, p in enumerate(prefix):
        lo, hi = np.searchsorted(posted, p, "left"), np.searchsorted(posted, p, "right")
        several = hi - lo > 1
        if not several.any():
            continue
        c = np.unique(np.concatenate([owner[x:y] for x, y in zip(lo[several].tolist(), hi[several].tolist(), strict=True)]))
        c = c[(c > i) & (label[c] != label[i]) & (percent * n[c] <= 100 * n[i])]
        if two:
            c = c[side[c] != side[i]]
        if not len(c):
            continue
        own = ids[starts[i] : starts[i + 1]]
        seen[own] = True
        for k in range(0, len(c), 4096):
            some = c[k : k + 4096]
            first = np.cumsum(n[some]) - n[some]
            at = np.repeat(starts[some] - first, n[some]) + np.arange(n[some].sum())
            met = np.add.reduceat(seen[ids[at]], first, dtype=np.int64)
            for j in some[similar(met, n[some], n[i], percent)].tolist():
                if label[j] != label[i]:
                    links.append((int(keys[i]), int(keys[j])))
                    label[label == label[j]] = label[i]
        seen[own] = False
    return links


def _blocks(percent: int):
    """Streams rows (cluster, x, y, own, key, label, h) sorted by cluster, x, y: the links of each block with the other, or with itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def links() -> pa.RecordBatch:
            found = compare(np.array([r[1] for r in rows]), [np.frombuffer(r[3], np.int64) for r in rows], np.array([r[2] for r in rows]), np.array([r[0] for r in rows]), percent) if cell[1] == cell[2] or len({r[0] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in it:
            for *at, own, key, label, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cell != at:
                    if rows:
                        yield links()
                    cell, rows = at, []
                rows.append((own, key, label, h))
        if rows:
            yield links()

    return run


def clusters(large: DataFrame, label: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, label, cluster, own, other), written: nodes of ``large`` (h, key) regions that have several labels, dealt to pairs of blocks. ``label``: (key, label); ``sizes``: (key, n)."""
    rows = large.join(label, "key")
    several = rows.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("key").alias("least")).filter("lo <> hi")
    rows = materialize(rows.join(several.select("h", "least"), "h").select("key", "label", "least").distinct(), "crowd")
    edges = materialize(rows.select(F.col("key").alias("a"), F.col("least").alias("b")), "crowd_edges")
    root = components(edges)
    crowd = rows.select("key", "label").distinct().join(root.select(F.col("node").alias("key"), "root"), "key", "left").join(sizes, "key")
    crowd = materialize(crowd.select("key", "label", F.coalesce("root", "key").alias("cluster"), "n"), "clusters")
    size = crowd.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), (8 * F.sum("n")).alias("bytes"))
    blocks = F.greatest(F.least(F.ceil(F.col("m") / BLOCK_NODES), F.lit(SPREAD)), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = crowd.join(size.select("cluster", blocks.alias("blocks")), "cluster").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    out = materialize(dealt.select("key", "label", "cluster", "own", "blocks"), "dealt")
    discard(rows, edges, crowd)
    return out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def links(sets: DataFrame, docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """(a, b) pairs of set keys of ``percent`` similarity or more, written, whose components are those of all such pairs. Empty sets are linked with nothing.

    ``sets``: the ``sketch`` of ``docs``; ``known``: pairs (a, b) of keys of other origin that may be similar, tried first."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")
    each = materialize(sets.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("regions").alias("regions"), F.first("sig").alias("sig"), F.min(place).alias("p")), "nodes")
    narrow = each.select("key", F.posexplode("regions").alias("tree", "h"))
    shared = materialize(narrow.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared")
    met = materialize(narrow.join(light(shared, F.lit(24)), "h").select("h", "key", "tree", "m"), "regions")
    some = materialize(met.select("key").distinct(), "some")
    signed = each.join(light(some, F.lit(16)), "key").select("key", "n", "sig")
    told = met.join(signed, "key").select("h", "key", "n", "sig", "tree", "m")
    small = told.filter(F.col("m") <= most).select("h", "key", "n", "sig").repartition(n, "h").sortWithinPartitions("h").mapInArrow(_small(percent), "a long, b long")
    cut = 2 * LEVELS * ((F.col("tree") + 1) % TREES)
    deeper = F.concat(F.expr(f"substring(sig, 1 + {2 * LEVELS} * ((tree + 1) % {TREES}))"), F.substring("sig", F.lit(1), cut))
    large = told.filter(F.col("m") > most).withColumn("deeper", deeper)
    beside = large.repartitionByRange(n, "h", "deeper", "key").sortWithinPartitions("h", "deeper", "key").select("h", "key", "n", "sig").mapInArrow(_neighbours, "key long, other long, like int")
    likeliest = F.slice(F.sort_array(F.collect_set(F.struct("like", "other")), asc=False), 1, 2)  # of at most two a tree
    tried = beside.groupBy("key").agg(likeliest.alias("best")).select("key", F.explode("best.other").alias("other"))
    pairs = small.union(tried.select(F.least("key", "other"), F.greatest("key", "other")))
    if known is not None:
        pairs = pairs.union(known.select(F.least("a", "b"), F.greatest("a", "b")))
    pairs = materialize(pairs.distinct(), "pairs")

    crowd = met.filter(F.col("m") > most).select("key").union(pairs.select(F.explode(F.array("a", "b")))).distinct()
    full = sets_of(crowd, docs, each.select("key", "p.doc_id", "p.row"), doc_id, text, shingle)
    found = confirmed(pairs, full, each.select("key", "n"), percent)
    discard(pairs, shared, some)
    crowded = met.filter(F.col("m") > most).select("h", "key")
    if not crowded.isEmpty():
        root = components(found).select(F.col("node").alias("key"), "root")
        label = crowded.select("key").distinct().join(root, "key", "left").select("key", F.coalesce("root", "key").alias("label"))
        dealt = clusters(crowded, label, each.select("key", "n")).join(full, "key")
        dealt = dealt.select("cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "label", "h")
        more = dealt.repartition(n, "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").mapInArrow(_blocks(percent), "a long, b long")
        found = materialize(found.union(more), "similar")
    discard(each, met, full)
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its set, and the least doc_id that links reach, itself included.

    Null and wordless texts have an empty set and are linked with nothing, not with each other; a component without any doc_id has a null
    component_id; repeated rows each get a row; different texts under one id are nodes of their own; an empty table gives no rows; other columns are ignored."""
    sets = sketch(docs, doc_id, text, shingle)
    edges = links(sets, docs, None, doc_id, text, percent, shingle, most)
    named = name_groups(sets.filter("n > 0").select("doc_id", "row", "key", F.col("n").alias("size")), edges, "key")
    out = named.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))
    return out.union(sets.filter("n = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id").alias("component_id")))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles, component and whether it stands for it."""
    d = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return d.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def oracle_sql() -> str:
    """The same by every pair that shares a shingle, with components by least ids."""
    return f"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), sets AS (
      SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' ')) END) AS s FROM words
    ), each AS (
      SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL
    ), rows AS (
      SELECT id, n, unnest(s) AS t FROM each
    ), met AS (
      SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM rows a JOIN rows b ON a.t = b.t AND a.id < b.id AND a.n * 100 >= b.n * {PERCENT} AND b.n * 100 >= a.n * {PERCENT} GROUP BY ALL
    ), linked AS (
      SELECT a, b FROM met WHERE 100 * shared >= {PERCENT} * (na + nb - shared)
    ), both_ways AS (
      SELECT a, b FROM linked UNION SELECT b, a FROM linked
    ), reached(a, b) AS (
      SELECT id, id FROM each WHERE id IN (SELECT a FROM both_ways) UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a
    ), least AS (
      SELECT a, min(b) AS root FROM reached GROUP BY a
    ), named AS (
      SELECT sets.doc_id, len(sets.s) AS n, each.id FROM sets LEFT JOIN each ON list_sort(sets.s) = each.s AND len(sets.s) > 0
    )
    SELECT doc_id, n::BIGINT AS n_shingles, coalesce(root, id, doc_id) AS component_id, doc_id = coalesce(root, id, doc_id) AS kept FROM named LEFT JOIN least ON id = a
    """
