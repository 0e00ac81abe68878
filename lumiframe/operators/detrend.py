"""Field traces, running-percentile and exponential trends, and their removal."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import kernels
from lumiframe.operators.movie import PLANE


def field_trace(movie: DataFrame, mask: DataFrame | None = None, keys: Sequence[str] = PLANE, relative: bool = True) -> DataFrame:
    """(t, v): mean over the mask's pixels of each frame, relative to the first frame unless that is zero."""
    m = movie if mask is None else movie.join(mask.select(*keys).distinct(), list(keys), "left_semi")
    mean = m.groupBy("t").agg(F.avg("v").alias("v"))
    if not relative:
        return mean
    first = mean.agg(F.min_by("v", "t").alias("__f"))
    return mean.crossJoin(F.broadcast(first)).select("t", F.when(F.col("__f") != 0, F.col("v") / F.col("__f")).otherwise(F.col("v")).alias("v"))


def running_percentile(trace: DataFrame, percent: float = 8.0, window: int = 200, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., t, v, trend): linear-interpolated percentile of the last ``window`` samples, fewer at the start."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-(max(1, window) - 1), Window.currentRow)
    return trace.withColumn("trend", F.percentile("v", F.lit(percent / 100)).over(w))


def asymmetric_huber(r: Column, below: float, above: float) -> tuple[Column, Column]:
    """(loss, gradient) of a residual: quadratic within [-below, above], linear outside."""
    c = F.greatest(F.least(r, F.lit(above)), F.lit(-below))
    return F.lit(0.5) * c * c + c * (r - c), c


def exponential_guess(trace: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., a, b) of a * exp(-t / b) by least squares on the logarithms of the samples that stand clear of the noise."""

    def guess(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        a, b = initial_exponential(p["t"].to_numpy(float), p["v"].to_numpy(float))
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in keys}, "a": [a], "b": [b]})

    head = "".join(f"{k} {trace.schema[k].dataType.simpleString()}, " for k in keys)
    return trace.groupBy(*keys).applyInPandas(guess, f"{head}a double, b double")


def initial_exponential(t: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    sigma = kernels.noise_std(v)
    least = max(3 * sigma, max(float(v.max()), 1.0) * 1e-6)
    use = v > least
    if use.sum() < 2:
        use = np.ones(len(v), bool)
    logs = np.log(np.maximum(v[use], least))
    slope, start = np.polyfit(t[use], logs, 1) if len(set(t[use])) > 1 else (0.0, logs.mean())
    return float(max(np.exp(start), least)), float(-1 / slope) if slope < 0 else float(max(t[-1], 1.0))


def fit_exponential(t: np.ndarray, v: np.ndarray, below: float = 3.0, above: float = 1.0, rounds: int = 200) -> tuple[float, float]:
    """(a, b) that minimise the asymmetric Huber loss of the residual over the noise: damped Newton steps (Levenberg) in log a and log b."""
    sigma = kernels.noise_std(v)
    below, above = below * sigma, above * sigma
    p = np.log(np.maximum(initial_exponential(t, v), 1e-12))

    def state(p: np.ndarray):
        f = np.exp(p[0] - t / np.exp(p[1]))
        r = v - f
        c = np.clip(r, -below, above)
        jac = np.stack((f, f * t / np.exp(p[1])), axis=1)
        return float(np.sum(0.5 * c * c + c * (r - c))), c, jac, (r == c).astype(float)

    loss, c, jac, inner = state(p)
    damp = 1e-3
    for _ in range(rounds):
        h = (jac * np.maximum(inner, 1e-3)[:, None]).T @ jac
        step = np.linalg.solve(h + damp * (np.diag(np.diag(h)) + 1e-12 * np.eye(2)), jac.T @ c)
        trial = p + np.clip(step, -1, 1)
        new = state(trial)
        if new[0] < loss:
            done = loss - new[0] <= 1e-12 * max(loss, 1e-300)
            p, (loss, c, jac, inner), damp = trial, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(np.exp(p[0])), float(np.exp(p[1]))


def exponential_trend(trace: DataFrame, keys: Sequence[str] = (), below: float = 3.0, above: float = 1.0) -> DataFrame:
    """(keys..., t, v, a, b, trend): a robust exponential fit of each trace."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        a, b = fit_exponential(p["t"].to_numpy(float), p["v"].to_numpy(float), below, above)
        return p[[*keys, "t", "v"]].assign(a=a, b=b)

    head = "".join(f"{k} {trace.schema[k].dataType.simpleString()}, " for k in keys)
    got = trace.groupBy(*keys).applyInPandas(fit, f"{head}t int, v double, a double, b double")
    return got.withColumn("trend", F.col("a") * F.exp(-F.col("t") / F.col("b")))


def remove_trend(movie: DataFrame, trend: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    """v over (trend / mean trend). The trend has one row a frame: frames grow with the recording, so it is joined, not forced to be broadcast."""
    mean = trend.agg(F.avg("trend").alias("__mean"))
    rel = trend.crossJoin(F.broadcast(mean)).select("t", F.try_divide("trend", "__mean").alias("__f"))
    return movie.join(rel, "t").select(*keys, "t", F.try_divide("v", "__f").alias("v"))


def detrend(movie: DataFrame, percent: float = 8.0, window: int = 200, mask: DataFrame | None = None, keys: Sequence[str] = PLANE) -> DataFrame:
    return remove_trend(movie, running_percentile(field_trace(movie, mask, keys), percent, window), keys)


def detrend_exponential(movie: DataFrame, mask: DataFrame | None = None, keys: Sequence[str] = PLANE) -> DataFrame:
    return remove_trend(movie, exponential_trend(field_trace(movie, mask, keys)).select("t", "trend"), keys)
