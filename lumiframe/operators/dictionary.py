"""Graph-filtered temporal dictionaries: traces are sparse non-negative sums of a few time courses, and pixels with similar traces share
them. Fields, patches of fields and restricted volumes go through one kernel on (pixels x frames)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.operators import masks, transients
from lumiframe.operators.graph import _checkpoint
from lumiframe.operators.movie import PLANE
from lumiframe.operators.patches import assign, starts


def similarity_graph(places: np.ndarray, traces: np.ndarray, neighbours: int = 8, reach: float = 3.0) -> np.ndarray:
    """Row-normalised weights of each pixel's most correlated neighbours within ``reach``; negative correlations count as none."""
    z = traces - traces.mean(1, keepdims=True)
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    c = np.maximum(z @ z.T, 0)
    far = ((places[:, None] - places[None]) ** 2).sum(-1) > reach * reach
    c[far] = 0
    np.fill_diagonal(c, 0)
    if c.shape[0] > neighbours:
        cut = -np.partition(-c, neighbours - 1, axis=1)[:, neighbours - 1 : neighbours]
        c[c < cut] = 0
    return c / np.maximum(c.sum(1, keepdims=True), 1e-12)


def sparse_codes(traces: np.ndarray, book: np.ndarray, weights: np.ndarray, start: np.ndarray, steps: int = 60) -> np.ndarray:
    """Non-negative codes of all pixels at once: accelerated proximal gradient with a weight for each pixel and time course."""
    gram, right = book @ book.T, traces @ book.T
    size = max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    x = ahead = start
    m = 1.0
    for _ in range(steps):
        new = np.maximum(ahead - (ahead @ gram - right + weights) / size, 0)
        n = (1 + np.sqrt(1 + 4 * m * m)) / 2
        ahead, x, m = new + (m - 1) / n * (new - x), new, n
    return x


def learn(places: np.ndarray, traces: np.ndarray, n: int = 20, rounds: int = 15, sparsity: float = 0.1, graph: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(codes, time courses): codes under weights that fall where a pixel or its neighbours use a time course already, then a non-negative
    least-squares update of the time courses, scaled to unit length."""
    y = np.asarray(traces, float)
    y = y - np.median(y, axis=1, keepdims=True)
    scale = np.abs(y).max() or 1.0
    y = y / scale
    w = similarity_graph(places, y)
    rng = np.random.default_rng(seed)
    energy = (y**2).sum(1)
    pick = rng.choice(len(y), min(n, len(y)), replace=False, p=energy / energy.sum() if energy.sum() > 0 else None)
    book = np.maximum(y[pick], 0) + 1e-6
    book /= np.linalg.norm(book, axis=1, keepdims=True)
    codes = np.zeros((len(y), len(book)))
    for _ in range(rounds):
        seen = codes + graph * (w @ codes)
        codes = sparse_codes(y, book, sparsity / (1 + seen / max(float(codes.max()), 1e-12) * 10), codes)
        gram = codes.T @ codes + 1e-6 * np.eye(len(book))
        for k in range(len(book)):
            book[k] = np.maximum(book[k] + (codes[:, k] @ y - gram[k] @ book) / gram[k, k], 0)
            size = np.linalg.norm(book[k])
            if size > 1e-9:
                book[k] /= size
            else:  # an unused time course starts again from the worst explained trace
                worst = int(((y - codes @ book) ** 2).sum(1).argmax())
                book[k] = np.maximum(y[worst], 0) + 1e-9
                book[k] /= np.linalg.norm(book[k])
                codes[:, k] = 0
    return codes * scale, book


def extract(movie: DataFrame, shape: Sequence[int], patch: Sequence[int] = (50, 50), overlap: Sequence[int] = (10, 10), n: int = 10, least: float = 0.8, strong: float = 0.3, least_pixels: int = 5, mask: DataFrame | None = None, keys: Sequence[str] = PLANE, **options) -> tuple[DataFrame, DataFrame]:
    """(footprints (roi, keys..., weight), traces (roi, t, v)) of a field or volume, patch by patch.

    A volume needs a mask (keys...) that leaves something in and something out. Codes above ``strong`` times their largest make a footprint;
    footprints of neighbouring patches that overlap and correlate are merged; traces are measured on the movie."""
    keys = list(keys)
    if len(keys) == 3:
        if mask is None:
            raise ValueError("a volume needs a mask")
        inside, every = mask.select(*keys).distinct().count(), movie.select(*keys).distinct().count()
        if not 0 < inside < every:
            raise ValueError("the mask must leave voxels in and out")
    m = movie if mask is None else movie.join(mask.select(*keys).distinct(), keys, "left_semi")
    axes = {k: (starts(s, p, o), p) for k, s, p, o in zip(keys, shape, patch, overlap, strict=True)}

    def one(p: pd.DataFrame) -> pd.DataFrame:
        places, at = np.unique(p[keys].to_numpy(), axis=0, return_inverse=True)
        ts, ti = np.unique(p["t"], return_inverse=True)
        y = np.zeros((len(places), len(ts)))
        y[at.ravel(), ti] = p["v"]
        codes, _ = learn(places, y, n, **options)
        base = int(p["patch"].iloc[0]) * 100_000
        rows = []
        for k in range(codes.shape[1]):
            on = np.flatnonzero(codes[:, k] > strong * max(codes[:, k].max(), 1e-12))
            if len(on) >= least_pixels:
                rows += [(base + k, *map(int, places[i]), float(codes[i, k])) for i in on]
        return pd.DataFrame(rows, columns=["roi", *keys, "weight"])

    found = _checkpoint(assign(m, axes).groupBy("patch").applyInPandas(one, "roi long, " + ", ".join(f"{k} int" for k in keys) + ", weight double"))
    groups = transients.merge_groups(found, masks.region_traces(movie, found, keys), least, keys)
    merged = found.join(groups, "roi").groupBy(F.col("group").alias("roi"), *keys).agg(F.max("weight").alias("weight"))
    return merged, masks.region_traces(movie, merged, keys)
