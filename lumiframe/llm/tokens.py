"""Tokenizers on the executors, and offset-mapped token counts.

Ids are those of the byte-level BPE in ``byte_bpe_50k.json``; the merge loop runs over the same vocabulary's rank
file, which gives the same ids several times faster. A text that holds a special token's string goes through the
JSON tokenizer itself, which alone knows those, and so does a text that the fast one breaks off at (runs of about a
million spaces overflow its pattern's stack).
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lumiframe.llm.common import spread, table, text_batches

JSON_FILE, RANK_FILE, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"


@lru_cache(maxsize=2)
def _rank_encoding(path: str | None):
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path(RANK_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _json_tokenizer(path: str | None):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or P.path(JSON_FILE))


@lru_cache(maxsize=2)
def _byte_lengths(path: str | None) -> np.ndarray:
    e = _rank_encoding(path)
    out = np.zeros(e.n_vocab + 1, np.int64)
    for token, rank in e._mergeable_ranks.items():
        out[rank] = len(token)
    out[-1] = len(SPECIAL)
    return out


def encode(text: str | None, rank_path: str | None = None, json_path: str | None = None) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit integers; none for a null or empty text."""
    if not text:
        return np.zeros(0, np.uint32)
    if SPECIAL in text:
        return np.array(_json_tokenizer(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
    try:
        return np.array(_rank_encoding(rank_path).encode_ordinary(text), np.uint32)
    except BaseException as e:
        if type(e).__name__ != "PanicException":  # a panic of the native code is no Exception
            raise
    return np.array(_json_tokenizer(json_path).encode(text, add_special_tokens=False).ids, np.uint32)


def char_spans(text: str, ids: np.ndarray, rank_path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each token in code points: a token that holds part of a character's bytes spans the whole character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(_byte_lengths(rank_path)[np.minimum(ids, len(_byte_lengths(rank_path)) - 1)])
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    return char_of[starts], char_of[ends - 1] + 1


RULES = ("start", "majority")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with sections [bounds[k], bounds[k+1]): (section of each token, whether it crosses a boundary).

    ``start``: a token belongs to the section of its first character; ``majority``: to the section that holds most of its
    characters, ties to the earlier one."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crosses = first != last
    if rule == "majority" and crosses.any():
        first = first.copy()
        for i in np.flatnonzero(crosses):
            edges = np.concatenate(([starts[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]]))
            first[i] += int(np.argmax(np.diff(edges)))
    return first, crosses


def line_bounds(text: str) -> np.ndarray:
    """Sections of a text: its lines, each with its newline; an empty text has one empty section."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cuts = np.flatnonzero(codes == 10) + 1
    return np.unique(np.concatenate(([0], cuts[cuts < len(codes)]))) if len(codes) else np.zeros(1, np.int64)


TOKEN_COUNTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType())]
)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: str = "majority", rank_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """Tokens of each section (line) of each document: a document is encoded once, as a whole, and its tokens' character
    spans are joined to the sections' spans; n_crossing counts the section's tokens that reach into another one.

    A document's counts add up to its tokens. Null and empty texts have one section without tokens; repeated rows and ids are
    counted row by row; a null id stays null; no shuffle, so an executor's loss costs its own partitions only."""

    def run(it):
        for b in text_batches(it, text):
            out: list[list] = [[] for _ in TOKEN_COUNTS.names]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t or ""
                bounds = line_bounds(t)
                s, e = char_spans(t, ids := encode(t, rank_path, json_path), rank_path)
                sec, cross = attribute(s, e, bounds, rule)
                n = len(bounds)
                stops = np.append(bounds[1:], len(t))
                assert len(ids) == len(sec)
                for col, x in zip(out, (np.full(n, -1 if d is None else d), np.arange(n), bounds, stops, np.bincount(sec, minlength=n), np.bincount(sec[cross], minlength=n)), strict=True):
                    col.append(x)
            if out[0]:
                cols = [np.concatenate(x) for x in out]
                null = np.repeat([d is None for d in b.column(0).to_pylist()], [len(x) for x in out[0]])
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64(), mask=null), pa.array(cols[1], pa.int32()), *[pa.array(x, pa.int64()) for x in cols[2:]]], names=TOKEN_COUNTS.names)

    return docs.select(doc_id, text).mapInArrow(run, TOKEN_COUNTS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every line of every document, boundary-crossing tokens to the line that holds most of them."""
    return token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
