"""Counts, rates and averages with stated denominators and exact decimal rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rows() -> Column:
    return F.count(F.lit(1))


def rows_where(flag: Column) -> Column:
    return F.count_if(flag)


def sum_where(value: Column, flag: Column) -> Column:
    """NULL, not zero, when no row qualifies."""
    return F.sum(F.when(flag, value))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 x part / whole, rounded half away from zero; NULL on a zero denominator."""
    exact = F.try_divide(part.cast("decimal(24,2)") * 100, whole.cast("decimal(24,2)"))
    return F.round(exact, digits).cast("double")


def fraction(part: Column, whole: Column, digits: int) -> Column:
    exact = F.try_divide(part.cast("decimal(24,2)"), whole.cast("decimal(24,2)"))
    return F.round(exact, digits).cast("double")


def mean_from(total: Column, count: Column, digits: int) -> Column:
    """Average from its two additive parts, so that partial results can be combined."""
    return fraction(total, count, digits)


def ratio(part: Column, whole: Column) -> Column:
    """Unrounded part / whole; NULL on a zero denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def whole_units(total: Column) -> Column:
    """Money rounded to whole units."""
    return F.round(total, 0).cast("long")


def median_tenths(value: Column, rows: Column) -> Column:
    """Exact median of a one-decimal value that occurs ``rows`` times, rounded to one decimal.

    Works on integer tenths, so the half step between two neighbours is exact.
    """
    return F.floor(F.percentile((value * 10).cast("long"), 0.5, rows) + F.lit(0.5)) / F.lit(10.0)
