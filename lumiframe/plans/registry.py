"""Collects every imaging query and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumiframe.plans import extraction, imaging

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    return [imaging, extraction]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
