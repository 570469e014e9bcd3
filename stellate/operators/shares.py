"""Shares of a total over an already aggregated frame of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.functions.rates import percent


def total_over(column: str, within: Sequence[str] = ()) -> Column:
    return F.sum(column).over(Window.partitionBy(*within))


def with_share(
    totals: DataFrame, column: str, name: str, digits: int, within: Sequence[str] = ()
) -> DataFrame:
    """Adds column / total x 100. The input is a report (labels x totals), not detail rows."""
    return totals.withColumn(name, percent(F.col(column), total_over(column, within), digits))
