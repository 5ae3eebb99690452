"""Guarded statistics: null instead of a division by zero or a not-a-number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def tidy(c: Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, places) + F.lit(0.0)


def no_nan(c: Column) -> Column:
    """Not-a-number as null; Spark's averages skip nulls only."""
    return F.when(~F.isnan(c), c)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's over the rows that have both, as an aggregate; null where either side is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(scale > TINY, scale)
