"""Hierarchical multi-length packing of tokenised documents.

Documents are cut into full windows of the longest context; what is left of each is routed to the tier of context sizes
(powers of two) that it fits. Tiers are packed from the longest to the shortest: a window opens with the tier's largest piece,
its gap is filled with the best fitting pieces of shorter tiers, and the last one is cut to fit. Windows therefore are full, and
a full window of a power of two needs no padding. What is left when a partition ends is cut to ever shorter powers of two.

Each partition packs its own documents in a bounded buffer: there is no shuffle, tokens never leave the task, and the cost of a
partition's end (at most one short window a tier) doesn't grow with the partition. Sequences are dealt to step groups of equal
token counts, tier by tier.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lumiframe.llm.common import spread, table, text_batches
from lumiframe.llm.tokens import encode

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 65_536
END_ID = 1
BUFFER_TOKENS = 1 << 19

PACKED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType())]
)


class Packer:
    """Packs (doc_id, ids) pairs; ``rows`` holds finished pieces in the order of ``PACKED``."""

    def __init__(self, partition: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers must be rising powers of two")
        self.tiers, self.step_tokens, self.buffer_tokens, self.base = tiers, step_tokens, buffer_tokens, partition << 36
        self.rows: list[tuple] = []
        self.lens: list[int] = []  # of the held pieces, rising
        self.held: list[tuple] = []  # (doc_id, start, doc_tokens, ids), in the same order
        self.tokens = 0
        self.sequences = 0
        self.of_tier: dict[int, int] = {}

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, top, at = len(ids), self.tiers[-1], 0
        while n - at >= top:
            self._window([(doc_id, at, n, ids[at : at + top])], top)
            at += top
        if at < n:
            self._hold((doc_id, at, n, ids[at:]))
        if self.tokens >= self.buffer_tokens:
            self.pack(self.tiers[-1])

    def _hold(self, piece: tuple) -> None:
        n = len(piece[3])
        k = bisect_left(self.lens, n)
        self.lens.insert(k, n)
        self.held.insert(k, piece)
        self.tokens += n

    def _take(self, k: int, most: int) -> tuple:
        """Held piece k, or its first ``most`` tokens; the rest is held again."""
        self.lens.pop(k)
        d, s, n, ids = self.held.pop(k)
        self.tokens -= len(ids)
        if len(ids) > most:
            self._hold((d, s + most, n, ids[most:]))
        return d, s, n, ids[:most]

    def _window(self, pieces: list[tuple], size: int) -> None:
        seq = self.base + self.sequences
        self.sequences += 1
        nth = self.of_tier.get(size, 0)
        self.of_tier[size] = nth + 1
        group = self.base + (size.bit_length() << 30) + nth // max(1, self.step_tokens // size)
        off = 0
        for d, s, n, ids in pieces:
            self.rows.append((d, s, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), n, seq, off, size, group))
            off += len(ids)

    def _fill(self, size: int) -> None:
        """One full window: the largest piece that fits opens it, best fits follow, the last is cut."""
        pieces, gap = [], size
        while gap:
            k = bisect_right(self.lens, gap) - 1
            piece = self._take(max(k, 0), gap)
            pieces.append(piece)
            gap -= len(piece[3])
        self._window(pieces, size)

    def pack(self, reserve: int) -> None:
        """Packs tier by tier; ``reserve`` tokens are kept as filling for what comes later."""
        for size in reversed(self.tiers):
            under = size // 2 if size > self.tiers[0] else 0
            while self.lens and self.lens[-1] > under and self.tokens - size >= reserve:
                if self.lens[-1] > size:  # left from a longer tier that ran out of filling
                    self._fill(self.tiers[-1] if self.lens[-1] >= self.tiers[-1] else size)
                else:
                    self._fill(size)

    def finish(self) -> None:
        """Packs all that is held; the tail goes to powers of two under the shortest tier."""
        self.pack(0)
        size = self.tiers[-1]
        while self.tokens:
            while size > self.tokens:
                size //= 2
            self._fill(size)

    def drain(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, end_id: int = END_ID, rank_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence.

    A null or empty text is the end id alone; each repeated row is a document of its own; a null id stays null; very long texts
    are cut; an empty table gives no rows; other columns are ignored. Sequence ids are (partition, number in it)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = Packer(TaskContext.get().partitionId(), tiers, step_tokens)

        def rows() -> Iterator[pa.RecordBatch]:
            if got := p.drain():
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "tier" else pa.int64()) for n, x in zip(PACKED.names, zip(*got, strict=True), strict=True)], names=PACKED.names)

        for b in text_batches(it, text):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p.add(d, np.append(encode(t, rank_path, json_path), np.uint32(end_id)))
            yield from rows()
        p.finish()
        yield from rows()

    return docs.select(doc_id, text).mapInArrow(run, PACKED)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2,048 tokens."""
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
