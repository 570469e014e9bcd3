"""Time intelligence.

Every function takes a frame that has already been reduced to one row per calendar day or period of a group, so
that a window runs over a few thousand rows. ``trailing_days`` and ``with_prior_year`` want a calendar without gaps; the
others also take the days alone that have facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily_totals(
    calendar: DataFrame, fact: DataFrame, parts: dict[str, Column], key: str = "date_key"
) -> DataFrame:
    """Calendar days with the day's totals; days without facts are kept and count zero."""
    totals = fact.groupBy(key).agg(*[agg.alias(name) for name, agg in parts.items()])
    return calendar.join(totals, key, "left").na.fill(0, list(parts))


def to_date(column: str, day: str, within: Sequence[str]) -> Column:
    """Running total that restarts with every period (month-to-date, year-to-date)."""
    window = Window.partitionBy(*within).orderBy(day)
    return F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def running_total(column: str, day: str) -> Column:
    return to_date(column, day, [])


def trailing_days(column: str, day: str, days: int, within: Sequence[str] = ()) -> Column:
    """Sum over the day and the days - 1 before it; the calendar has no gaps, so rows are days."""
    window = Window.partitionBy(*within).orderBy(day)
    return F.sum(column).over(window.rowsBetween(1 - days, Window.currentRow))


def trailing_range(column: str, day: str, days: int, within: Sequence[str] = ()) -> Column:
    """Sum over the day and the days - 1 before it, whichever of them have rows."""
    window = Window.partitionBy(*within).orderBy(F.unix_date(F.col(day)))
    return F.sum(column).over(window.rangeBetween(1 - days, 0))


def with_prior_year(
    periods: DataFrame, start: str, columns: Sequence[str], suffix: str, within: Sequence[str] = ()
) -> DataFrame:
    """Adds the same period of the same group one year earlier; NULL where the calendar has none.

    ``start`` is the first day of the period. At day grain, 29 February looks
    back to 28 February.
    """
    prior = periods.select(
        F.col(start).alias("_prior"),
        *[F.col(c).alias(f"_prior_{c}") for c in within],
        *[F.col(c).alias(c + suffix) for c in columns],
    )
    back = F.add_months(F.col(start), -12)
    same = [F.col("_back") == F.col("_prior"), *[F.col(c).eqNullSafe(F.col(f"_prior_{c}")) for c in within]]
    return periods.withColumn("_back", back).join(prior, same, "left").drop(
        "_back", "_prior", *[f"_prior_{c}" for c in within]
    )


def change_from_previous(column: str, order: str) -> Column:
    """Percent change from the row before; NULL on the first row."""
    before = F.lag(column).over(Window.orderBy(order)).cast("double")
    return F.try_divide(F.col(column).cast("double") - before, before) * 100


def change_from_first(column: str, order: str) -> Column:
    """Percent change of the last row against the first."""
    whole = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(column).over(whole).cast("double")
    last = F.last(column).over(whole).cast("double")
    return F.try_divide(last - first, first) * 100
