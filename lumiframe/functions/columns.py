"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null where a side doesn't vary (``corr`` itself is an error there in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


def or_zero(c: Column) -> Column:
    """Null and NaN become zero."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
