"""Substring deduplication by suffix automata of reference shards.

A word goes if a window of 13 consecutive words that covers it also starts in a document with a smaller id. The text that can't
repeat is kept away from the automata first:

1. Sketch. Every window is keyed by its minimizer, the least hash of its 6-word sequences; equal windows have equal keys, and neighbouring
   windows mostly share one. Keys are shuffled, and those seen in two documents or more go back to their documents.
2. Shards. Runs of windows with the same repeated key are cut out as segments and shuffled by key. A shard is the segments of one
   key, so a window and all its copies meet in one shard and no automaton has to see the whole corpus: sending every shard's
   automaton to every document, the literal form of the method, costs the square of the corpus.
3. Automata. The shard's distinct segments are put into a suffix automaton in the order of their least document ids; a state keeps the
   document that first reached it. Each segment is streamed through it: wherever the matching statistic is 13 or more, the state of
   the last 13 words tells the least document that holds them. Spans whose windows all have an earlier document are removed.

Hot keys: within a chunk of documents, a key or a segment that many of them hold is sent once, with the list of its holders; whatever
is known to repeat inside the chunk doesn't wait for the shuffle. A key of more than ``MOST_HOLDERS`` documents makes no shard, whose automaton
would outgrow a task: each of its windows is a segment with a shard of its own, by the hash of its words, and from each chunk it goes only for
the chunk's least document (all others in the chunk are known to repeat). Both kinds are cut out of a text in one pass. So a shard is
bounded by ``MOST_HOLDERS`` documents or has one text, and its segments by ``MOST_WINDOWS`` windows. Words, not hashes, decide: hashes only pick the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm.common import materialize, partitions, table, text_batches

WINDOW = 13
GRAM = 6
MOST_HOLDERS = 1 << 14
MOST_WINDOWS = 1 << 10

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK_BYTES = 4 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of an UTF-8 text, words split at ASCII white space: differences of one running sum."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, _U)
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not _POWERS or len(_POWERS[0]) <= len(b):
        n = max(len(b) + 1, 1 << 16)
        _POWERS[:] = [_powers(_BASE, n), _powers(_INV, n)]
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((b.astype(_U) + _U(1)) * _POWERS[0][: len(b)])))
    out = _mixed((sums[ends] - sums[starts]) * _POWERS[1][starts] + (ends - starts).astype(_U))
    if len(_POWERS[0]) > 1 << 22:  # one very long text doesn't keep its tables
        _POWERS.clear()
    return out


def window_keys(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The minimizer of every window of a text."""
    w = word_hashes(raw)
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, _U)
    g = np.zeros(len(w) - gram + 1, _U)
    for k in range(gram):
        g *= _U(0x2545F4914F6CDD1D)
        g += w[k : k + len(g)]
    g, span, need = _mixed(g), 1, window - gram + 1
    while span < need:
        step = min(span, need - span)
        g = np.minimum(g[: len(g) - step], g[step:])
        span += step
    return g[:n]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


SKETCH = "at long, key long, doc_id long, row long"  # a finished row has no ``at``; others are dealt by it


def _sketch(window: int):
    """Distinct (key, document) pairs of each chunk. A key of two documents in the chunk is finished for all; one row of it still goes to meet the other chunks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(it, "text", _CHUNK_BYTES):
            keys, owner = [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                if t:
                    m = np.unique(window_keys(t.encode(), window))
                    keys.append(m)
                    owner.append(np.full(len(m), k))
            if not keys:
                continue
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            rows = b.column(1).to_numpy(zero_copy_only=False)
            order = np.lexsort((ids[owner], keys))
            keys, owner = keys[order], owner[order]
            starts, sizes = _runs(keys) if len(keys) else (np.zeros(0, int), np.zeros(0, int))
            several = np.zeros(len(starts), bool)
            if len(starts):
                several = ids[owner[starts]] != ids[owner[starts + sizes - 1]]
            finished = np.repeat(several, sizes)
            # one row of a finished key, the rest as they are; copies of a row with the same id are kept apart by ``row``
            first = np.zeros(len(keys), bool)
            first[starts] = True
            sent = ~finished | first
            at = np.concatenate((keys[sent].view(np.int64), np.zeros(int(finished.sum()), np.int64)))
            none = np.concatenate((np.zeros(int(sent.sum()), bool), np.ones(int(finished.sum()), bool)))
            pick = np.concatenate((np.flatnonzero(sent), np.flatnonzero(finished)))
            for c in range(0, len(pick), 1 << 16):
                p = pick[c : c + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[c : c + (1 << 16)], mask=none[c : c + (1 << 16)]), pa.array(keys[p].view(np.int64)), pa.array(ids[owner[p]]), pa.array(rows[owner[p]])], names=["at", "key", "doc_id", "row"]
                )

    return run


def _repeated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (at, doc_id): rows of keys that two documents hold pass. Of an open run only its first document and its rows so far are carried, and no rows once it is known to repeat."""
    key, first, wait, many = None, None, [], False
    for b in it:
        at = b.column(0)
        null = at.is_null().to_numpy(zero_copy_only=False)
        k, d, r = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
        out = [(k[null], d[null], r[null])]
        k, d, r = k[~null], d[~null], r[~null]
        if len(k):
            starts, sizes = _runs(k)
            ends = starts + sizes - 1
            several = d[starts] != d[ends]
            if key is not None and k[0] == key:
                several[0] = several[0] or many or first != d[0] or first != d[ends[0]]
                head = first
                if several[0] and wait:
                    out += wait
                    wait = []
            else:
                wait, head = [], d[starts[0]]
            if len(starts) > 1:
                wait, head = [], d[starts[-1]]
            keep = np.repeat(several, sizes)
            out.append((k[keep], d[keep], r[keep]))
            key, first, many = k[-1], head, bool(several[-1])
            if not many:
                s = starts[-1]
                wait.append((k[s:], d[s:], r[s:]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "doc_id", "row"])


SEGMENT = "key long, least long, words string, holders binary"  # without words, holders are finished spans


def _segment_rows(key: list[int], least: list[int], words: list[bytes | None], holders: list[bytes]) -> Iterator[pa.RecordBatch]:
    for c in range(0, len(key), 1 << 13):
        cut = slice(c, c + (1 << 13))
        cols = [pa.array(key[cut], pa.int64()), pa.array(least[cut], pa.int64()), pa.array(words[cut], pa.binary()).cast(pa.string()), pa.array(holders[cut], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "least", "words", "holders"])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _lone(held: dict[bytes, list], window: int) -> Iterator[pa.RecordBatch]:
    """Windows of hot keys as segments: each for the chunk's least document, to meet the other chunks; for the chunk's other documents finished spans."""
    from xxhash import xxh64_intdigest

    items, done = [], []
    for words, holders in held.items():
        least = min(holders)[0]
        items.append((_signed(xxh64_intdigest(words, 42)), least, words, np.array([h for h in holders if h[0] == least], "<i8").tobytes()))
        done += [h for h in holders if h[0] != least]
    joined: list[list[int]] = []
    for d, r, s in sorted(done):  # neighbouring windows are one span
        if joined and joined[-1][:2] == [d, r] and s <= joined[-1][3]:
            joined[-1][3] = s + window
        else:
            joined.append([d, r, s, s + window])
    items += [(r, d, None, np.array([d, r, a, b], "<i8").tobytes()) for d, r, a, b in joined]
    if items:
        yield from _segment_rows(*map(list, zip(*items, strict=True)))


def _segments(window: int):
    """Runs of windows with a repeated key, cut out as text; equal segments of a chunk go out once, with their holders as (doc_id, row, first word) triples."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(it, "text", _CHUNK_BYTES):
            held: dict[tuple, list] = {}
            alone: dict[bytes, list] = {}
            for d, r, t, want, lone in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                raw = t.encode()
                keys = window_keys(raw, window)
                hit = np.isin(keys.view(np.int64), np.array(want, np.int64))
                starts, sizes = _runs(keys)
                words = raw.split()
                for first, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                    if hit[first]:
                        for s in range(first, first + size, MOST_WINDOWS):
                            n = min(MOST_WINDOWS, first + size - s)
                            held.setdefault((int(keys[s].view(np.int64)), b" ".join(words[s : s + n + window - 1])), []).append((d, r, s))
                if lone:
                    for s in np.flatnonzero(np.isin(keys.view(np.int64), np.array(lone, np.int64))).tolist():
                        alone.setdefault(b" ".join(words[s : s + window]), []).append((d, r, s))
            yield from _segment_rows([k[0] for k in held], [min(h)[0] for h in held.values()], [k[1] for k in held], [np.array(h, "<i8").tobytes() for h in held.values()])
            yield from _lone(alone, window)

    return run


class Automaton:
    """Suffix automaton of word sequences; every state keeps the document whose sequence reached it first."""

    __slots__ = ("first", "length", "link", "next")

    def __init__(self) -> None:
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [0]

    def _state(self, length: int, link: int, nxt: dict, doc: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.first.append(doc)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The part of q's sequences that p reaches by ``word``, as a state of its own: they had been reached as early as q."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list, doc: int) -> None:
        """Adds one sequence. Sequences must come in the order of their documents."""
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, w)
                continue
            cur = self._state(length[last] + 1, 0, {}, doc)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = cur

    def earliest(self, words: list, window: int) -> list[int | None]:
        """For each window of ``words``: the document that first had it, by matching statistics held at the window's length."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v = n = 0
        out = []
        for k, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            while v and length[link[v]] >= window:
                v = link[v]
                n = length[v]
            n = min(n, window) if n > window else n
            if k >= window - 1:
                out.append(first[v] if n >= window else None)
        return out


class _Shard:
    """The segments of one key. A segment's windows get their first documents when it is met first: those that came before it, else its own least one.

    A shard's first segment has nobody before it; it is put into the automaton when a second, different one asks for it."""

    __slots__ = ("known", "machine", "window")

    def __init__(self, window: int):
        self.window, self.machine, self.known = window, None, {}

    def firsts(self, words: str, least: int) -> tuple[int, int, np.ndarray | None, int]:
        """(smallest, largest, all, number) of the first documents of the segment's windows; all is left out where they are one."""
        got = self.known.get(words)
        if got is None:
            if not self.known:
                n = words.count(" ") + 2 - self.window
                got = least, least, None, n
            else:
                if self.machine is None:
                    self.machine = Automaton()
                    one, (doc, *_) = next(iter(self.known.items()))
                    self.machine.add(one.encode().split(b" "), doc)
                seq = words.encode().split(b" ")
                found = [least if f is None else f for f in self.machine.earliest(seq, self.window)]
                self.machine.add(seq, least)
                lo, hi = min(found), max(found)
                got = lo, hi, None if lo == hi else np.array(found, np.int64), len(found)
            self.known[words] = got
        return got


def _spans(window: int):
    """Streams segments sorted by (key, least id) through their shard."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, _Shard(window)
        for b in it:
            finished = b.filter(b.column(2).is_null()).column(3).to_pylist()
            done = np.frombuffer(b"".join(finished), "<i8").reshape(-1, 4).T
            b = b.filter(b.column(2).is_valid())
            found = []
            for k, least, words in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if k != key:
                    key, shard = k, _Shard(window)
                found.append(shard.firsts(words, least))
            holders = b.column(3).to_pylist()
            h = np.frombuffer(b"".join(holders), "<i8").reshape(-1, 3)
            per = np.array([len(x) // 24 for x in holders], np.int64)
            lo, hi, n = (np.repeat(np.array([f[c] for f in found], np.int64), per) for c in (0, 1, 3))
            whole = hi < h[:, 0]
            out = [done, np.stack((h[whole, 0], h[whole, 1], h[whole, 2], h[whole, 2] + n[whole] + window - 1))]
            seg = np.repeat(np.arange(len(found)), per)
            for i in np.flatnonzero(~whole & (lo < h[:, 0])).tolist():
                d, r, at = h[i].tolist()
                edge = np.diff(np.concatenate(([False], found[seg[i]][2] < d, [False])).astype(np.int8))
                s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                out.append(np.stack((np.full(len(s), d), np.full(len(s), r), at + s, at + e + window - 1)))
            cols = np.concatenate(out, axis=1)
            if cols.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["doc_id", "row", "a", "b"])

    return run


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, most_holders: int = MOST_HOLDERS) -> DataFrame:
    """(doc_id, row, a, b): word spans [a, b) to be removed; spans of a document may overlap. ``row`` tells rows with equal ids and different texts apart.

    Null texts, rows without an id and empty tables have none; rows equal in id and text share their spans."""
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    n = partitions(docs.sparkSession)
    sketch = src.mapInArrow(_sketch(window), SKETCH)
    dealt = sketch.repartition(n, F.coalesce("at", F.xxhash64("key", "row"))).sortWithinPartitions("at", "doc_id")
    keys = materialize(dealt.mapInArrow(_repeated, "key long, doc_id long, row long"), "repeated-keys")
    hot = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_holders).select("key", F.lit(True).alias("hot")), "hot-keys")
    marked = keys.withColumn("hot", F.lit(None).cast("boolean")) if hot.isEmpty() else keys.join(hot, "key", "left")
    wanted = marked.groupBy("doc_id", "row").agg(F.collect_set(F.when(F.col("hot").isNull(), F.col("key"))).alias("want"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("lone"))
    segments = src.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "want", "lone").mapInArrow(_segments(window), SEGMENT)
    return segments.repartition(n, "key").sortWithinPartitions("key", "least").mapInArrow(_spans(window), "doc_id long, row long, a long, b long")


def _covered(n: int, spans: list) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    for s in spans:
        mark[s["a"]] += 1
        mark[s["b"]] -= 1
    return np.cumsum(mark)[:n] > 0


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, most_holders: int = MOST_HOLDERS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the words left, joined by one space.

    A null text has no words; documents of fewer words than a window lose none; a row without an id loses nothing and is nobody's
    reference; rows with equal ids aren't earlier than each other; an empty table gives no rows; other columns are ignored."""
    spans = materialize(repeated_spans(docs, doc_id, text, window, most_holders), "spans").groupBy("doc_id", "row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "spans")
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    joined = src.join(spans, (src["doc_id"].cast("bigint") == spans["d"]) & (src["row"] == spans["r"]), "left").select("doc_id", "text", "spans")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(it, "text", _CHUNK_BYTES):
            n, gone, kept = [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (t or "").encode().split()
                if s:
                    out = _covered(len(words), s)
                    n.append(len(words))
                    gone.append(int(out.sum()))
                    kept.append(b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x]))
                else:
                    n.append(len(words))
                    gone.append(0)
                    kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that an earlier document holds."""
    d = deduplicate(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """The same by windows as lists of words."""
    return f"""with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i from w where len(ws) >= {WINDOW}),
g as (select doc_id, i, hash(ws[i:i+{WINDOW - 1}]) h, ws[i:i+{WINDOW - 1}] s from p),
f as (select h, s, min(doc_id) d from g group by h, s having min(doc_id) < max(doc_id)),
r as (select distinct g.doc_id, unnest(range(g.i, g.i + {WINDOW})) j from g join f on g.h = f.h and g.s = f.s where f.d < g.doc_id),
x as (select doc_id, list(j) js, count(*) n from r group by doc_id),
k as (select w.doc_id, len(ws) n_words, coalesce(n, 0) n_removed, case when n is null then array_to_string(ws, ' ') else coalesce(array_to_string(list_filter(ws, lambda v, q: not list_contains(js, q)), ' '), '') end t from w left join x using (doc_id))
select doc_id, n_words::bigint n_words, n_removed::bigint n_removed, sha256(t) kept_sha256 from k"""
