"""Date parts. Three weekday numberings are in use, so each has one named helper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def date_key(day: Column) -> Column:
    """yyyymmdd as an integer. Names the day once, so that a pushed-down filter parses it once."""
    return F.replace(day.cast("string"), F.lit("-"), F.lit("")).cast("int")


def iso_weekday(day: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(day) + 1).cast("short")


def sunday_zero_weekday(day: Column) -> Column:
    """Sunday 0 to Saturday 6."""
    return (F.dayofweek(day) - 1).cast("short")


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def weekday_text(iso: Column) -> Column:
    """Name of an ISO weekday number given as text or number."""
    return F.get(F.array(*[F.lit(name) for name in WEEKDAYS]), F.try_subtract(iso.try_cast("int"), F.lit(1)))


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def generated_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from first to last, whether or not anything happened on it."""
    day = F.col("full_date")
    return (
        spark.range(1)
        .select(
            F.explode(
                F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 day"))
            ).alias("full_date")
        )
        .select(
            date_key(day).alias("date_key"),
            day,
            F.dayofmonth(day).cast("short").alias("day_of_month"),
            day_name(day).alias("day_name"),
            iso_weekday(day).alias("day_of_week"),
            (iso_weekday(day) >= 6).alias("is_weekend"),
            F.month(day).cast("short").alias("month"),
            month_name(day).alias("month_name"),
            F.trunc(day, "month").alias("month_start"),
            F.quarter(day).cast("short").alias("quarter"),
            F.year(day).cast("short").alias("year"),
        )
    )


def harvested_calendar(dates: DataFrame, column: str) -> DataFrame:
    """Only the days that occur in the data, with Sunday as weekday 0."""
    day = F.col("full_date")
    return (
        dates.select(F.col(column).alias("full_date"))
        .distinct()
        .select(
            date_key(day).alias("date_key"),
            day,
            F.dayofmonth(day).cast("short").alias("day_of_month"),
            day_name(day).alias("day_name"),
            sunday_zero_weekday(day).alias("day_of_week"),
            F.month(day).cast("short").alias("month"),
            month_name(day).alias("month_name"),
            F.quarter(day).cast("short").alias("quarter"),
            F.year(day).cast("short").alias("year"),
        )
    )
