"""Raw text to typed values. A malformed value raises at the cast, where it can be seen and fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: Column, to: str = "decimal(12,2)") -> Column:
    """``'$-77.00'`` to a number."""
    return F.replace(col, F.lit("$"), F.lit("")).cast(to)


def whole_number(col: Column) -> Column:
    """``'58523.0'`` to 58523, rounding halves away from zero."""
    return F.round(col.cast("decimal(20,6)"), 0).cast("int")


def comma_list(col: Column) -> Column:
    """Comma-joined text to an array. NULL stays NULL; empty text is an empty array."""
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(col, ","))


def absent(col: Column, sentinel: str) -> Column:
    """Sentinel text to NULL."""
    return F.nullif(col, F.lit(sentinel))


def yes_no(col: Column, yes: str = "Y", no: str = "N") -> Column:
    """Three-valued flag: anything that is neither answer is unknown."""
    return F.when(col == yes, True).when(col == no, False)


def first_word(col: Column) -> Column:
    return F.substring_index(col, " ", 1)


def month_year(col: Column) -> Column:
    """``'07/2019'`` to the first day of that month."""
    return F.to_date(col, "MM/yyyy")
