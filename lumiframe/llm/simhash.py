"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common neighbour within half the radius of each. So every
distinct fingerprint emits all variants within half a radius, variants are shuffled, and fingerprints that meet on one are
compared. The whole 64-bit ball of radius 2 has 2,081 variants, 16 bytes each: sixteen times the input of this corpus. The ball is
therefore taken on block pairs: of three blocks of 21 or 22 bits, two differ together in at most ``2 * radius // 3`` = 2 bits, so
each of the three pairs emits its ball of radius 1 (44 variants with 22 + 21 bits, 131 in all) and any two fingerprints within 4
bits meet. Colliding pairs are verified on all 64 bits.

Hot variants: a run of more than ``most`` fingerprints is not compared pair by pair. Its members emit the whole 64-bit ball
instead; all that meet on such a variant are within ``radius`` of each other, so linking each to the least of them is exact, needs no
comparison, and is an aggregate that combines before the shuffle. Links are reduced to a forest where they are found, and
components come from star rounds (``components``). No link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm.common import discard, materialize, partitions, spread, table, text_batches
from lumiframe.llm.components import least_links
from lumiframe.llm.groups import name_groups, one_of_each, row_hash

RADIUS = 4
SHINGLE = 4
BLOCKS = ((0, 22), (22, 43), (43, 64))
MOST = 128


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included: words split at ASCII white space, A-Z lowered; fewer words are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], "<u8")
    return np.fromiter((xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))), "<u8", len(words) - shingle + 1)


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp) of each row: row is a hash of the text, fp the fingerprint as a signed long.

    Null and wordless texts have fingerprint zero; repeated rows each get a row; an empty table gives none; other columns are ignored."""

    def run(it):
        for b in text_batches(it, "text"):
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps)], names=["doc_id", "row", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), row_hash(text).alias("row"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, row long, fp long")


def _ball(bits: list[int], radius: int) -> np.ndarray:
    """All sums of at most ``radius`` of the given bits, zero included."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64)


def block_masks(blocks=BLOCKS) -> list[tuple[np.uint64, np.uint64, list[int]]]:
    """For each pair of blocks: mask of its bits, a tag in the third block's place, and its bits."""
    out = []
    for k, (lo, hi) in enumerate(blocks):
        kept = [b for b in range(64) if not lo <= b < hi]
        out.append((np.uint64(sum(1 << b for b in kept)), np.uint64((k + 1) << lo), kept))
    return out


def _pair_variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, index) of all block-pair balls of the given fingerprints."""
    half = (2 * RADIUS // 3) // 2
    keys = []
    for mask, tag, kept in block_masks():
        keys.append((((fps & mask) | tag)[:, None] ^ _ball(kept, half)[None, :]).ravel())
    n = [len(k) // max(1, len(fps)) for k in keys]
    return np.concatenate(keys), np.concatenate([np.repeat(np.arange(len(fps)), m) for m in n])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def _links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted), and the members of runs longer than ``most``."""
    starts, sizes = _runs(keys)
    hot = sizes > most
    hot_fps = np.unique(fps[np.repeat(hot, sizes)]) if hot.any() else fps[:0]
    few = np.repeat(~hot & (sizes > 1), sizes)
    k, f = keys[few], fps[few]
    a, b = [], []
    for step in range(1, int(sizes[~hot].max(initial=1))):
        i = np.flatnonzero(k[step:] == k[:-step])
        if not len(i):
            break
        near = np.bitwise_count(f[i] ^ f[i + step]) <= RADIUS
        i = i[near & (f[i] != f[i + step])]
        a.append(f[i])
        b.append(f[i + step])
    if not a or not sum(map(len, a)):
        return f[:0], f[:0], hot_fps
    pair = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
    return (*least_links(pair[0], pair[1]), hot_fps)


ENTRY = "key long, fp long, to long"  # an entry has no ``to``; a row with it is a finished link, to itself if fp is hot
BUFFER = 1 << 19


def _rows(key: np.ndarray, fp: np.ndarray, to: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(key), 1 << 16):
        cut = [x[k : k + (1 << 16)].view(np.int64) for x in ((key, fp) if to is None else (key, fp, to))]
        yield pa.RecordBatch.from_arrays([pa.array(cut[0]), pa.array(cut[1]), pa.nulls(len(cut[0]), pa.int64()) if to is None else pa.array(cut[2])], names=["key", "fp", "to"])


def _emit_pairs(most: int):
    """Block-pair variants of each chunk of fingerprints. A variant that is hot within its chunk goes out most + 1 times only; all its members are told to be hot."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for c in range(0, b.num_rows, 4096):
                fps = b.column(0).slice(c, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, idx = _pair_variants(fps)
                order = np.argsort(keys, kind="stable")
                keys, own = keys[order], fps[idx[order]]
                starts, sizes = _runs(keys)
                if sizes.max(initial=0) > most:
                    hot = np.unique(own[np.repeat(sizes > most, sizes)])
                    yield from _rows(hot, hot, hot)
                    keep = np.arange(len(keys)) - np.repeat(starts, sizes) <= most
                    keys, own = keys[keep], own[keep]
                yield from _rows(keys, own)

    return run


def _emit_balls(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole ball of half the radius of each hot fingerprint: each chunk sends every variant once, with the least fingerprint on it; the others are linked to that one here."""
    ball = _ball(list(range(64)), RADIUS // 2)
    for b in it:
        for c in range(0, b.num_rows, 1024):
            fps = np.sort(b.column(0).slice(c, 1024).to_numpy(zero_copy_only=False).view(np.uint64))
            keys = (fps[:, None] ^ ball[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            keys, own = keys[order], np.repeat(fps, len(ball))[order]
            starts, sizes = _runs(keys)
            first = np.repeat(own[starts], sizes)
            if (first != own).any():
                a, z = least_links(own[first != own], first[first != own])
                yield from _rows(a, a, z)
            yield from _rows(keys[starts], own[starts])


def _streamed(found, carried: int):
    """Streams rows sorted by key through ``found`` (whole runs -> links). A run that outgrows the buffer is given to ``found``
    piece by piece, its first ``carried`` entries each time; finished links pass."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        told: set[int] = set()

        def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a):
                new = np.fromiter((x != y or x not in told for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
                if len(told) < 1 << 20:  # only spares repeats of hot marks, which are one row in the end
                    told.update(a[a == b].tolist())
                a, b = a[new], b[new]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in it:
            k, f, to = (batch.column(c) for c in range(3))
            open_ = to.is_null().to_numpy(zero_copy_only=False)
            f = f.to_numpy(zero_copy_only=False).view(np.uint64)
            if not open_.all():
                yield from out(f[~open_], to.drop_null().to_numpy(zero_copy_only=False).view(np.uint64))
            keys, fps = np.concatenate((keys, k.to_numpy(zero_copy_only=False)[open_])), np.concatenate((fps, f[open_]))
            if len(keys) >= BUFFER:
                at = int(np.searchsorted(keys, keys[-1], "left"))
                if at:
                    yield from out(*found(keys[:at], fps[:at]))
                    keys, fps = keys[at:], fps[at:]
                if len(keys) >= BUFFER // 2:
                    yield from out(*found(keys, fps))
                    keys, fps = keys[:carried], fps[:carried]
        yield from out(*found(keys, fps))

    return run


def _met_pairs(most: int):
    def found(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, hot = _links(keys, fps, most)
        return np.concatenate((a, hot)), np.concatenate((b, hot))

    return found


def _met_balls(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, sizes = _runs(keys)
    first = np.repeat(fps[starts], sizes)
    other = first != fps
    return least_links(fps[other], first[other]) if other.any() else (fps[:0], fps[:0])


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): a forest whose components are those of "differ in at most 4 bits" among the distinct ``fp`` of ``fps``."""
    n = partitions(fps.sparkSession)
    met = lambda sent, found, carried: sent.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_streamed(found, carried), "a long, b long")
    met_pairs = materialize(met(fps.select("fp").repartition(n, F.xxhash64("fp")).mapInArrow(_emit_pairs(most), ENTRY), _met_pairs(most), most + 1), "links")
    hot = met_pairs.filter("a = b").select(F.col("a").alias("fp")).distinct()
    near = met_pairs.filter("a <> b")
    if not hot.isEmpty():
        near = materialize(near.union(met(hot.mapInArrow(_emit_balls, ENTRY), _met_balls, 1)), "links")
        discard(met_pairs)
    else:
        near._lumiframe_path = met_pairs._lumiframe_path
    return near


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """(doc_id, fp, root, component_id): root is the component's least fingerprint, component_id the least doc_id that links of
    fingerprints reach, itself included.

    Null and wordless texts have fingerprint zero and are linked like any other; a component without any doc_id has a null
    component_id; repeated rows each get a row; an empty table gives no rows; other columns are ignored."""
    return _named(docs, doc_id, text, shingle, most).select("doc_id", "fp", "root", F.col("first.doc_id").alias("component_id"))


def _named(docs: DataFrame, doc_id: str, text: str, shingle: int, most: int) -> DataFrame:
    d = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    near = links(d.select("fp").distinct(), most)
    named = name_groups(d, near)
    discard(near)
    return named


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id; of different texts under that id the one with the least
    fingerprint, then the least text hash. Rows without an id stand for a component only if it has no other; of rows equal in id and text
    one stays. Null and wordless texts are one component. Columns are untouched; an empty table stays empty."""
    return one_of_each(docs, _named(docs, doc_id, text, shingle, most), "fp", doc_id, text)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    d = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
