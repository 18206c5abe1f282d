"""Ratios and rounding as the reports define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(n: Column, d: Column) -> Column:
    """Whole percent, half up; 0 for an empty denominator."""
    return F.when(F.coalesce(d, F.lit(0)) <= 0, F.lit(0).cast("bigint")).otherwise(F.floor(n * 100 / F.greatest(d, F.lit(1)) + 0.5)).cast("bigint")


def percent(n: Column, d: Column) -> Column:
    """Percent with two decimals, half up; 0.0 for an empty denominator."""
    return F.when(F.coalesce(d, F.lit(0)) <= 0, F.lit(0.0)).otherwise(F.floor(n * 10000 / F.greatest(d, F.lit(1)) + 0.5) / 100)


def safe_div(n: Column, d: Column) -> Column:
    """A quotient; 0.0 for a zero denominator."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def whole_mean(total: Column, n: Column) -> Column:
    """Whole mean of integers, half up; null for none."""
    return F.floor(F.try_divide(2 * total + n, 2 * n)).cast("bigint")


def count_if(condition: Column) -> Column:
    """Rows for which a condition holds; an unknown one doesn't count."""
    return F.count(F.when(condition, 1))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
