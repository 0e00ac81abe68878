"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Each component of a unit vector gets one of its sixteen centres, four bits. Codebooks and codes minimise the score-aware loss, in which the
residual parallel to the vector costs ``eta`` times the residual across it: that part is what moves large inner products.
Codebooks are fitted on a bounded sample (``SAMPLE``); every row is coded once, and codes are written beside the vectors.

A search streams the coded rows once for each ``QUERIES_PER_PASS`` queries, which are broadcast; one such broadcast lives at a time. A scan
adds up table entries, two codes a byte. The best ``RERANK`` rows of a task's first batch are scored exactly, which gives each query a fifth best so far.
With a residual of ``rho`` along the row and ``perp`` across it, a scan score a bounds the cosine by (a + perp) / (1 - rho): every row
whose bound reaches the fifth best is scored exactly, so no cap loses a neighbour, and near copies that share a code are told
apart. Each task keeps five rows a query; these meet in one small shuffle. Rows are never shuffled and never paired with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiframe.llm.common import discard, materialize, table

SAMPLE = 8_192
QUERIES_PER_PASS = 4_096
RERANK = 32
CENTRES = 16
PART = 1
THRESHOLD = 0.2
ROUNDS = 6


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual for inner products above ``threshold``."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


@dataclass
class Model:
    dim: int
    books: np.ndarray  # parts x centres x PART
    weight: float

    def parts(self, unit: np.ndarray) -> np.ndarray:
        pad = self.books.shape[0] * PART - self.dim
        return np.pad(unit, ((0, 0), (0, pad))).reshape(len(unit), -1, PART)

    def encode(self, unit: np.ndarray, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, each residual's part along its row, length of the part across): nearest centres first, then sweeps of coordinate descent on the score-aware loss."""
        x = self.parts(unit)
        n, m, _ = x.shape
        codes = np.zeros((n, m), np.uint8)
        for j in range(m):
            codes[:, j] = ((x[:, j, None, :] - self.books[j][None]) ** 2).sum(2).argmin(1)
        rows = np.arange(n)
        parallel = np.zeros(n)
        for j in range(m):
            parallel += ((x[:, j] - self.books[j][codes[:, j]]) * x[:, j]).sum(1)
        for _ in range(sweeps):
            for j in range(m):
                r = x[:, j, None, :] - self.books[j][None]
                along = (r * x[:, j, None, :]).sum(2)
                rest = parallel - along[rows, codes[:, j]]
                loss = (r**2).sum(2) + (self.weight - 1) * (rest[:, None] + along) ** 2
                codes[:, j] = loss.argmin(1)
                parallel = rest + along[rows, codes[:, j]]
        decoded = np.stack([self.books[j][codes[:, j]] for j in range(m)], axis=1)
        r = x - decoded
        rho = (r * x).sum((1, 2))
        return codes, rho, np.sqrt(np.maximum((r**2).sum((1, 2)) - rho**2, 0))

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """queries x bytes x 256 inner products: a byte holds the codes of two parts."""
        t = np.einsum("qmp,mcp->qmc", self.parts(unit), self.books)
        if t.shape[1] % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(t), -1, CENTRES * CENTRES).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, the first in the low half."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def fit_books(unit: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Begins with quantiles, then alternates codes and centres; a centre's update solves the normal equations of the score-aware loss."""
    n, dim = unit.shape
    m = -(-dim // PART)
    x = np.pad(unit, ((0, 0), (0, m * PART - dim))).reshape(n, m, PART)
    books = np.quantile(x, (np.arange(CENTRES) + 0.5) / CENTRES, axis=0).transpose(1, 0, 2)
    model = Model(dim, books, 1.0)
    for k in range(rounds):
        model.weight = 1.0 if k < rounds // 2 else eta(dim)
        codes, _, _ = model.encode(unit, 0 if k < rounds // 2 else 1)
        w = model.weight - 1
        parallel = sum(((x[:, j] - books[j][codes[:, j]]) * x[:, j]).sum(1) for j in range(m))
        for j in range(m):
            own = ((x[:, j] - books[j][codes[:, j]]) * x[:, j]).sum(1)
            rest = parallel - own
            outer = np.eye(PART)[None] + w * x[:, j, :, None] * x[:, j, None, :]
            right = x[:, j] * (1 + w * (rest + (x[:, j] ** 2).sum(1)))[:, None]
            for c in range(CENTRES):
                of = codes[:, j] == c
                if of.any():
                    books[j, c] = np.linalg.solve(outer[of].sum(0), right[of].sum(0))
            parallel = rest + ((x[:, j] - books[j][codes[:, j]]) * x[:, j]).sum(1)
    model.weight = eta(dim)
    return model


def valid_rows(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors as doubles) of the rows that take part: id and vector not null, ``dim`` finite components, not all zero."""
    ok = pc.and_(pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), dim), pc.is_valid(ids))
    ids, vectors = ids.filter(ok), vectors.filter(ok)
    x = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null component is nan here
    take = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids.to_numpy(zero_copy_only=False)[take], x[take]


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def cosines(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return in_order(a, b) / (na * nb)


class _Best:
    """The ``k`` best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def put(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        own = np.unique(q)
        qs = np.concatenate((q, np.repeat(own, k)))
        ss, ii = np.concatenate((score, self.score[own].ravel())), np.concatenate((ids, self.id[own].ravel()))
        order = np.lexsort((ii, -ss, qs))
        qs, ss, ii = qs[order], ss[order], ii[order]
        start = np.searchsorted(qs, own)
        pick = start[:, None] + np.arange(k)
        self.score[own], self.id[own] = ss[pick], ii[pick]


def _scan(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """queries x rows sums of table entries; ``codes`` are bytes x rows."""
    out, entry = np.zeros((len(tables), codes.shape[1]), np.float32), np.empty((len(tables), codes.shape[1]), np.float32)
    for j, c in enumerate(codes):
        out += np.take(tables[:, j].copy(), c, axis=1, out=entry, mode="clip")
    return out


class Searcher:
    """Streams coded rows past a block of queries; ``scored`` of ``pairs`` pairs so far were scored exactly."""

    def __init__(self, model: Model, qid: np.ndarray, q: np.ndarray, k: int):
        self.model, self.qid, self.q, self.best = model, qid, q, _Best(len(qid), k)
        self.norm = np.sqrt(in_order(q, q)) if len(q) else np.zeros(0)
        self.scored = self.pairs = 0

    def add(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, rho: np.ndarray, perp: np.ndarray) -> None:
        xn = np.sqrt(in_order(x, x))
        slack = (perp + 1e-5).astype(np.float32)  # single-precision sums
        scale, more = np.where(rho < 0.5, 1 / np.maximum(1 - rho, 0.5), 1).astype(np.float32), np.where(rho < 0.5, 0, np.abs(rho)).astype(np.float32)
        first, codes = self.pairs == 0, codes.T.astype(np.intp)
        for s in range(0, len(self.qid), 64):
            qid, q, norm = self.qid[s : s + 64], self.q[s : s + 64], self.norm[s : s + 64]
            approx = _scan(codes, self.model.tables(q / norm[:, None]))
            bound = (approx + slack + more) * scale + 1e-6
            own = qid[:, None] == ids[None]
            bound[own] = -np.inf
            done = np.zeros(bound.shape, bool)
            if first:
                r = min(RERANK, len(ids))
                np.put_along_axis(done, np.argpartition(-np.where(own, -np.inf, approx), r - 1, axis=1)[:, :r], True, axis=1)
                self._score(s, done & ~own, ids, x, xn)
            self._score(s, ~done & ~own & (bound >= self.best.score[s : s + 64, -1:]), ids, x, xn)
        self.pairs += len(self.qid) * len(ids)

    def _score(self, s: int, todo: np.ndarray, ids: np.ndarray, x: np.ndarray, xn: np.ndarray) -> None:
        a, e = np.nonzero(todo)
        self.scored += len(a)
        for z in range(0, len(a), 1 << 16):
            i, j = a[z : z + (1 << 16)] + s, e[z : z + (1 << 16)]
            self.best.put(i, cosines(self.q[i], x[j], self.norm[i], xn[j]), ids[j])


def _coded(data: DataFrame, model: Model) -> DataFrame:
    """(vec_id, v, codes, rho, perp) of every valid row, written."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for c in range(0, b.num_rows, 8192):
                ids, x = valid_rows(b.column(0).slice(c, 8192), b.column(1).slice(c, 8192), model.dim)
                if len(ids):
                    codes, rho, perp = model.encode(x / np.sqrt(in_order(x, x))[:, None])
                    v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, model.dim, dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), v, pa.array([c.tobytes() for c in packed(codes)], pa.binary()), pa.array(rho), pa.array(perp)], names=["vec_id", "v", "codes", "rho", "perp"])

    return materialize(data.mapInArrow(run, "vec_id long, v array<double>, codes binary, rho double, perp double"), "codes")


def _passes(rows: DataFrame, queries: DataFrame, model: Model, k: int, passes: int) -> Iterator[DataFrame]:
    """The best k of each task's rows for each query, pass by pass. A caller that has done with a pass's result may go on; its broadcast then goes."""
    spark = rows.sparkSession
    for p in range(passes):
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toArrow()
        qid, q = valid_rows(got.column(0).combine_chunks(), got.column(1).combine_chunks(), model.dim) if got.num_rows else (np.zeros(0, np.int64), np.zeros((0, model.dim)))
        qid, at = np.unique(qid, return_index=True)
        if not len(qid):
            continue
        sent = spark.sparkContext.broadcast((model, qid, q[at]))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = Searcher(*sent.value, k)
            for b in it:
                for c in range(0, b.num_rows, 8192):
                    part = b.slice(c, 8192)
                    ids, x = valid_rows(part.column(0), part.column(1), search.model.dim)
                    codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                    search.add(ids, x, codes, *(part.column(z).to_numpy(zero_copy_only=False) for z in (3, 4)))
            i, j = np.nonzero(np.isfinite(search.best.score))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(search.qid[i]), pa.array(search.best.id[i, j]), pa.array(search.best.score[i, j])], names=["query_id", "vec_id", "score"])

        yield rows.mapInArrow(run, FOUND)
        sent.unpersist()


FOUND = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", queries_per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine for each query, its own id left out, ties to the smaller id.

    Rows whose vector is null, zero, empty, or holds null or non-finite components take no part, nor do rows without an id; vectors of different lengths are
    spaces of their own; fewer candidates than k are all returned; a repeated id is a candidate each time it occurs, of a repeated query
    one row is asked; empty tables give no rows; other columns are ignored."""
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    data, asked = pick(vectors), pick(queries)
    found: list[DataFrame] = []
    spaces = sorted((r[0], r[1]) for r in asked.groupBy(F.size("v")).count().collect())
    several = len(spaces) > 1 or any(n > queries_per_pass for _, n in spaces)
    for dim, n in spaces:
        own = data.filter(F.size("v") == dim)
        n_rows = own.count()
        drawn = own.filter(F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1_000_003)) < F.lit(math.ceil(1_000_003 * min(1.0, SAMPLE / max(1, n_rows))))).toArrow()
        ids, sample = valid_rows(drawn.column(0).combine_chunks(), drawn.column(1).combine_chunks(), dim) if drawn.num_rows else (np.zeros(0), np.zeros((0, dim)))
        sample = sample[np.argsort(ids, kind="stable")] if len(ids) else np.eye(1, dim)  # where no valid row was drawn any codebook does
        model = fit_books(sample / np.sqrt(in_order(sample, sample))[:, None])
        rows = _coded(own, model)
        for one in _passes(rows, asked.filter(F.size("v") == dim), model, k, -(-n // queries_per_pass)):
            found.append(materialize(one, "nearest") if several else one)
        if several:
            discard(rows)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose vec_id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    return search(e, e.filter("vec_id % 50 = 0"))


def oracle_sql() -> str:
    return """with v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings where vec_id is not null and embedding is not null),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) l from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.l * c.l) score from n q join n c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) rank, vec_id, score from p)
select query_id, rank::int rank, vec_id, score from r where rank <= 5"""
