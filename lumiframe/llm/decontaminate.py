"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH, exact edit verification.

Items and documents are sequences of words (lower case, ``\\w+``). The CGK random walk reads a window word by word, writes the word it
stands on at every step, and moves on when a random bit of (step, word) says so: windows at a small edit distance get embeddings at a
small Hamming distance. Each of several walks is sampled in several bands of a few steps; a window and an item that agree on all
steps of one band are candidates. ``bands_for`` gives the number of bands that reaches a target recall.

Windows have the size of the items, in classes: an item of L words is indexed by all its sub-windows of the largest class size W with
W + stride - 1 <= L, and documents are read in windows of W words at every stride-th word, so one sub-window lies on the
document's grid wherever the item stands. Windows with more words unknown to the benchmark than any allowed number of edits are
passed over: they can't match.

Beside that, an item that allows d edits is cut into d + 1 pieces, of which one stands unchanged in every match. All pieces are looked up at every
word, so no match is lost to chance; items under five words allow no edit and are a single piece. Scripts without spaces count by characters.

Every candidate is verified by the exact word edit distance of the whole item to the best span around it. The index of at most
``ITEMS_PER_PASS`` items is broadcast; more items take more passes over the documents, so the broadcast has a bound.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.llm.common import fresh, materialize, spread, table, text_batches

SIMILARITY = 0.8
#: Items of fewer words allow no edit: they are found by their one piece alone.
LEAST_WORDS = 5
ITEMS_PER_PASS = 2_000
WALKS = 2
SAMPLED = 4
#: Candidates whose whole embeddings differ in a larger share of the steps aren't verified; unrelated windows differ in nearly all.
MOST_DIFFERING = 0.8
TARGET_RECALL = 0.95
SEED = 20_241

_WORD = re.compile(r"\w+")
#: Scripts written without spaces (Thai, Lao, Tibetan, Burmese, Khmer, Chinese, Japanese): each character is a word.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD_OR_SIGN = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (_WORD if text.isascii() or not _HAS_UNSPACED.search(text) else _WORD_OR_SIGN).findall(text)


def pieces(n_words: int, edits: int) -> list[tuple[int, int]]:
    """(offset, words) of edits + 1 pieces of an item: each edit spoils one at most, so one of them stands unchanged in every match."""
    cuts = [k * n_words // (edits + 1) for k in range(edits + 2)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _piece_keys(mixed: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    acc = np.full(max(0, len(mixed) - n + 1), n, np.uint64)
    for k in range(n):
        acc = (acc ^ mixed[k : k + len(acc)]) * _MIX
        acc ^= acc >> np.uint64(32)
    return acc


def edits_allowed(n_words: int, similarity: float = SIMILARITY) -> int:
    """Most edits d with 1 - d / n >= similarity."""
    return int(math.floor((1 - similarity) * n_words + 1e-9))


def ladder(most: int = 64) -> list[int]:
    out = [4]
    while out[-1] < most:
        out.append(min(most, max(out[-1] + 1, out[-1] * 5 // 4)))
    return out


def stride(w: int) -> int:
    return max(1, w // 4)


def window_size(n_words: int) -> int:
    return max((w for w in ladder() if w + stride(w) - 1 <= n_words), default=n_words)


def bands_for(target: float = TARGET_RECALL, differing: float = 0.4, sampled: int = SAMPLED) -> int:
    """Bands of ``sampled`` steps that find, with probability ``target``, a window whose embedding differs in that share of its steps."""
    return math.ceil(math.log(1 - target) / math.log(1 - (1 - differing) ** sampled))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass
class Plan:
    """The random choices for windows of w words: bits of each walk's steps, and the steps that each band samples."""

    w: int
    walks: list[tuple[np.ndarray, np.ndarray]]  # (multipliers of the steps, bands x steps)

    @staticmethod
    def of(w: int, walks: int = WALKS, bands: int | None = None, sampled: int = SAMPLED) -> Plan:
        rng = np.random.default_rng([SEED, w])
        steps = w + w // 2
        each = -(-(bands or bands_for()) // walks)
        return Plan(w, [(rng.integers(0, 1 << 63, steps, np.uint64) * np.uint64(2) + np.uint64(1), np.stack([np.sort(rng.choice(steps, min(sampled, steps), replace=False)) for _ in range(each)])) for _ in range(walks)])

    def embed(self, walk: int, ids: np.ndarray, mixed: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Embeddings (steps x windows) of the windows at ``starts``; ``mixed`` are the mixed ids that give the walk's bits. Past its window's end a walk writes -1."""
        mult = self.walks[walk][0]
        at, last = starts.copy(), starts + (self.w - 1)
        out = np.empty((len(mult), len(starts)), np.int32)
        for s, m in enumerate(mult):
            # half the steps move on, so within 1.5 w steps a walk hardly ever passes its window's end
            over = at > last
            here = np.minimum(at, last) if over.any() else at
            out[s] = ids[here]
            if here is not at:
                out[s][over] = -1
            at = at + ((mixed[here] * m) >> np.uint64(63)).view(np.int64)
        return out

    def keys(self, walk: int, emb: np.ndarray) -> np.ndarray:
        """Hashes (bands x windows) of the sampled steps."""
        out = np.empty((len(self.walks[walk][1]), emb.shape[1]), np.uint64)
        for b, steps in enumerate(self.walks[walk][1]):
            acc = np.full(emb.shape[1], (walk * 64 + b + 1) * 1_000_003 + self.w, np.uint64)
            for s in steps:
                acc *= np.uint64(0x100000001B3)
                acc += emb[s].view(np.uint32)
            out[b] = _mixed(acc)
        return out


def edit_search(item: list, text: list) -> tuple[int, int]:
    """(least edit distance of ``item`` to a span of ``text``, exclusive end of the first such span), bit-parallel."""
    m = len(item)
    masks: dict = {}
    for k, x in enumerate(item):
        masks[x] = masks.get(x, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, x in enumerate(text):
        eq = masks.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may start anywhere: no carry into row 0
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def best_span(item: list, text: list) -> tuple[int, int, int]:
    """(distance, start, end) of the best span of ``text``."""
    d, end = edit_search(item, text)
    if d == len(item):
        return d, 0, 0
    back, n = edit_search(item[::-1], text[:end][::-1])
    return d, end - n, end


@dataclass
class Index:
    """What is broadcast: the benchmark's words, its items as ids, and the LSH tables by window size."""

    vocabulary: dict[str, int]
    items: list[tuple[object, list[int]]]
    plans: dict[int, Plan]
    tables: dict[int, tuple]  # sorted keys, sub-window of each; item and shift of each sub-window, its embeddings by walk, most edits in the class
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by words in a piece: sorted keys, item and offset of each
    similarity: float

    @staticmethod
    def of(rows: list[tuple[object, str | None]], similarity: float = SIMILARITY, bands: int | None = None) -> Index:
        vocabulary: dict[str, int] = {}
        items = []
        for i, t in rows:
            ws = words_of(t)
            if ws:
                items.append((i, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws]))
        plans, found = {}, {}
        cut: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, ids) in enumerate(items):
            if len(ids) >= LEAST_WORDS:
                found.setdefault(window_size(len(ids)), []).append(k)
            mixed = _mixed(np.array(ids, np.uint64))
            for at, n in pieces(len(ids), edits_allowed(len(ids), similarity)):
                cut.setdefault(n, []).append((int(_piece_keys(mixed[at : at + n], n)[0]), k, at))
        seeds = {}
        for n, got in cut.items():
            got.sort()
            key, item, at = zip(*got, strict=True)
            seeds[n] = np.array(key, np.uint64), np.array(item, np.int64), np.array(at, np.int64)
        tables = {}
        for w, members in found.items():
            plan = plans[w] = Plan.of(w, bands=bands)
            lens = [len(items[k][1]) for k in members]
            ids = np.concatenate([np.array(items[k][1], np.int64) for k in members])
            base = np.cumsum([0, *lens[:-1]])
            who = np.repeat(np.array(members, np.int32), [n - w + 1 for n in lens])
            shift = np.concatenate([np.arange(n - w + 1) for n in lens])
            starts = np.repeat(base, [n - w + 1 for n in lens]) + shift
            embs = [plan.embed(v, ids, _mixed(ids.astype(np.uint64)), starts) for v in range(len(plan.walks))]
            keys = np.concatenate([plan.keys(v, e).ravel() for v, e in enumerate(embs)])
            sub = np.concatenate([np.tile(np.arange(len(starts), dtype=np.int32), len(b)) for _, b in plan.walks])
            order = np.argsort(keys, kind="stable")
            tables[w] = keys[order], sub[order], who, shift, embs, max(edits_allowed(n, similarity) for n in lens)
        return Index(vocabulary, items, plans, tables, seeds, similarity)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, distance) of every match in a batch of texts."""
        if not self.items:
            return []
        lens = np.array([len(x) for _, x in self.items])
        allowed = np.array([edits_allowed(int(n), self.similarity) for n in lens])
        pad = int(allowed.max()) + 1
        get, none, parts, starts_of, at = self.vocabulary.get, itertools.repeat(0), [], [], 0
        gap = np.zeros(pad, np.int32)  # more unknown words than a window may hold: none spans two texts
        for t in texts:
            ids = np.array(list(map(get, words_of(t), none)), np.int32)
            starts_of.append(at)
            parts += (ids, gap)
            at += len(ids) + pad
        ids = np.concatenate(parts)
        if not ids.any():
            return []
        most = max(self.tables, default=0)
        ids = np.concatenate((ids, np.zeros(most, np.int32)))
        mixed = _mixed(ids.astype(np.uint64))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        found = set()
        for w, (keys, sub, who, shift, embs, edits) in self.tables.items():
            every = np.concatenate([np.arange(s, s + max(1, len(p)), stride(w)) for s, p in zip(starts_of, parts[::2], strict=True)])
            every = every[unknown[every + w] - unknown[every] <= edits]
            for c in range(0, len(every), 1 << 15):
                starts = every[c : c + (1 << 15)]
                for v in range(len(embs)):
                    emb = self.plans[w].embed(v, ids, mixed, starts)
                    got = self.plans[w].keys(v, emb).ravel()
                    lo = np.searchsorted(keys, got, "left")
                    hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == got)
                    n = np.searchsorted(keys, got[hit], "right") - lo[hit]
                    for h in range(0, len(hit), 1 << 14):
                        m = n[h : h + (1 << 14)]
                        rows = np.repeat(lo[hit[h : h + (1 << 14)]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                        pair = np.unique(np.repeat(hit[h : h + (1 << 14)] % len(starts), m).astype(np.int64) << 32 | sub[rows])
                        win, own = pair >> 32, pair & 0xFFFFFFFF
                        near = (emb[:, win] != embs[v][:, own]).mean(0) <= MOST_DIFFERING
                        found.update(zip(who[own[near]].tolist(), (starts[win[near]] - shift[own[near]]).tolist(), strict=True))
        for n, (keys, item, offset) in self.seeds.items():
            where = np.flatnonzero(unknown[n:] == unknown[:-n])
            got = _piece_keys(mixed, n)[where]
            lo = np.searchsorted(keys, got, "left")
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == got)
            m = np.searchsorted(keys, got[hit], "right") - lo[hit]
            for h in range(0, len(hit), 1 << 14):
                c = m[h : h + (1 << 14)]
                rows = np.repeat(lo[hit[h : h + (1 << 14)]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                who, place = item[rows], np.repeat(where[hit[h : h + (1 << 14)]], c) - offset[rows]
                # a match has all but the allowed edits of the item's words here
                a, z = np.clip(place - allowed[who], 0, len(ids)), np.clip(place + lens[who] + allowed[who], 0, len(ids))
                fits = z - a - (unknown[z] - unknown[a]) >= lens[who] - allowed[who]
                found.update(zip(who[fits].tolist(), place[fits].tolist(), strict=True))
        at = len(ids) - most
        out, ends = set(), [*starts_of[1:], at]
        offsets = np.array(starts_of)
        done: dict[int, list[tuple[int, int]]] = {}
        for k, place in sorted(found):
            item = self.items[k][1]
            d = edits_allowed(len(item), self.similarity)
            if any(s <= place + d and place - d < e and place + len(item) - d <= e + 2 * d for s, e in done.get(k, ())[-3:]):
                continue
            t = int(np.searchsorted(offsets, max(place, 0) if place + d < 0 else min(max(place + d, 0), at - 1), "right")) - 1
            lo, hi = max(starts_of[t], place - 2 * d), min(ends[t] - pad, place + len(item) + 2 * d)
            if hi <= lo:
                continue
            dist, s, e = best_span(item, ids[lo:hi].tolist())
            if dist <= d:
                out.add((t, k, lo + s - starts_of[t], e - s, dist))
                done.setdefault(k, []).append((lo + s, lo + e))
        return sorted(out)


def passes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", similarity: float = SIMILARITY, items_per_pass: int = ITEMS_PER_PASS) -> Iterator[tuple[Index, bool]]:
    """Indexes of at most about ``items_per_pass`` items each, built one at a time, and whether there are several; items without text are passed over."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t is not null")
    n = max(1, -(-rows.count() // items_per_pass))
    for k in range(n):
        got = rows.filter(F.pmod(F.xxhash64(F.col("i").cast("string"), "t"), F.lit(n)) == k).orderBy("i", "t").toArrow().to_pydict()
        yield Index.of(list(zip(got["i"], got["t"], strict=True)), similarity), n > 1


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, edit_distance, similarity) of every passage of a document within the allowed edits of a whole item.

    Null and empty texts match nothing; equal items each get their rows; repeated rows are searched row by row; an empty benchmark or
    table gives no rows; other columns are ignored. Where the items take several passes, each pass's matches are written before the next index is built."""
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word int, n_words int, edit_distance int, similarity double"
    out = None
    for index, several in passes(benchmark, similarity=similarity, items_per_pass=items_per_pass):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(it, sent=sent):
            ix = sent.value
            for b in text_batches(it, text):
                got = ix.search(b.column(1).to_pylist())
                if got:
                    t, k, s, n, d = map(list, zip(*got, strict=True))
                    items = [ix.items[x] for x in k]
                    sim = [1 - x / len(y[1]) for x, y in zip(d, items, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array([x[0] for x in items]), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(d, pa.int32()), pa.array(sim)], names=["doc_id", "item_id", "start_word", "n_words", "edit_distance", "similarity"])

        one = docs.select(doc_id, text).mapInArrow(run, schema)
        if several:
            one = materialize(one, "matches")
            sent.destroy()
        out = one if out is None else out.union(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of ``docs`` that hold no passage of an item, columns untouched; without a shuffle where the items take one pass.

    Null and empty texts hold none; an empty benchmark takes nothing; repeated rows fare alike. Several passes each write the hashes of the texts they found before
    the next index is built, and the texts go in the end."""
    at = docs.columns.index(text)
    bad = None
    mark = F.sha2(F.col(f"`{text}`"), 256)
    for index, several in passes(benchmark, similarity=similarity, items_per_pass=items_per_pass):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        if not several:

            def run(it, sent=sent):
                for b in text_batches(it, text):
                    bad = {x[0] for x in sent.value.search(b.column(at).to_pylist())}
                    yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

            return docs.mapInArrow(run, T.StructType(docs.schema.fields))

        def find(it, sent=sent):
            for b in text_batches(it, "text"):
                found = sorted({x[0] for x in sent.value.search(b.column(0).to_pylist())})
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(found, pa.int64()))], names=["mark"])

        one = materialize(docs.select(F.col(f"`{text}`").alias("text"), mark.alias("mark")).mapInArrow(find, "mark string"), "found")
        sent.destroy()
        bad = one if bad is None else bad.union(one)
    gone = fresh(docs, "__gone")
    return docs.join(bad.distinct().select(F.col("mark").alias(gone)), mark == F.col(gone), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document."""
    return matches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
