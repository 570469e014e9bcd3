"""Joins of values with half-open intervals that come as rows: equal keys only, no nested loops.

Few intervals become an index: their bounds cut the line into segments, a value finds its segment in a balanced tree of comparisons, and
segment meets segment. Many intervals are dealt into cells of 16, 256, ... values: an interval is the union of a few
cells of each size, a value lies in one cell of each size, and no interval is copied once per value or bin it spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, IntegralType, TimestampNTZType, TimestampType

from stellate.functions.literals import steps_passed

#: Intervals up to which their bounds are read back and made an index.
INDEX_ROWS = 256
_BITS = 4  # a cell holds 16 of the next smaller ones


def _overlaps(low: Column, high: Column) -> Column:
    """Not an empty interval: a NULL upper bound is open, a NULL lower one holds nothing."""
    return low.isNotNull() & (high.isNull() | (low < high))


def _segment(value: str, cuts: Sequence[object], kind: DataType) -> Column:
    """How many of the rising ``cuts`` are at or below the value; NULL for NULL."""
    return F.when(F.col(value).isNotNull(), steps_passed(value, cuts, kind))


def _summed(rows: DataFrame, key: str, totals: dict[str, Column]) -> DataFrame:
    """Sums per key, combined before the shuffle."""
    return rows.groupBy(key).agg(*[F.sum(c).alias(name) for name, c in totals.items()])


def _indexed(rows: DataFrame, value: str, intervals: DataFrame, lower: str, upper: str, how: str, totals: dict[str, Column] | None = None) -> DataFrame:
    """Joins by segment; every row has one, so outer rows stay single. ``intervals`` has at most INDEX_ROWS rows."""
    ends = [b for r in intervals.select(lower, upper).collect() for b in r if b is not None]
    cuts = sorted(set(ends))
    kind = intervals.schema[lower].dataType
    last = F.coalesce(_segment(upper, cuts, kind) - 1, F.lit(len(cuts)))
    pieces = intervals.filter(_overlaps(F.col(lower), F.col(upper))).withColumn("_segment", F.explode(F.sequence(_segment(lower, cuts, kind), last)))
    found = rows.withColumn("_segment", _segment(value, cuts, kind))
    if totals is not None:
        found = _summed(found.filter(F.col("_segment").isNotNull()), "_segment", totals)
    return found.join(F.broadcast(pieces), "_segment", how).drop("_segment")  # at most 2 x INDEX_ROWS segments of INDEX_ROWS rows


def _code(value: Column, kind: DataType, like: DataType) -> Column:
    """The least whole number that a value of type ``like`` at or above this one has: a scale of long integers for both sides."""
    if isinstance(like, DateType) and isinstance(kind, DateType):
        return F.unix_date(value).cast("long")
    if isinstance(like, (TimestampType, TimestampNTZType)) and isinstance(kind, type(like)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(like, (IntegralType, DecimalType)) and isinstance(kind, (IntegralType, DecimalType)):
        scale = like.scale if isinstance(like, DecimalType) else 0
        return F.ceil(value.cast("decimal(38,6)") * F.lit(10**scale).cast("decimal(19,0)")).cast("long")
    raise ValueError("values and bounds have to be whole or decimal numbers, dates or times; cast them to decimals")


def interval_join(
    rows: DataFrame,
    value: str,
    intervals: DataFrame,
    lower: str,
    upper: str,
    index_rows: int = INDEX_ROWS,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows with every interval that holds their value, lower <= value < upper; intervals may overlap.

    A NULL upper bound is open. NULL values, NULL lower bounds and empty intervals meet nothing. No column name may be on both sides.
    With ``totals`` (names and the columns of ``rows`` to sum) an interval meets the sums of all rows of a segment or cell inside it
    instead of each row: a few rows per interval, however many rows it holds, that add up to the sums over its rows.
    """
    if intervals.limit(index_rows + 1).count() <= index_rows:
        return _indexed(rows, value, intervals, lower, upper, "inner", totals)
    like, kind = rows.schema[value].dataType, intervals.schema[lower].dataType
    rows = rows.filter(F.col(value).isNotNull())
    ends = rows.agg(F.min(value).alias("least"), F.max(value).alias("greatest"))
    span = ends.select(*[_code(F.col(c), like, like).alias(c) for c in ends.columns]).first()
    coded = rows.withColumn("_code", _code(F.col(value), like, like))
    if totals is not None:  # once per value, so that a hot value or cell is one row a task
        rows = _summed(rows.withColumn("_value", F.col(value)), "_value", totals)
        coded = rows.withColumn("_code", _code(F.col("_value"), like, like)).drop("_value")
    if span["least"] is None:
        return coded.limit(0).drop("_code").crossJoin(intervals.limit(0))
    least, beyond = span["least"], span["greatest"] + 1
    # intervals are cut off where no value lies, and begin at 0
    low = F.greatest(_code(F.col(lower), kind, like), F.lit(least)) - least
    high = F.least(F.coalesce(_code(F.col(upper), kind, like), F.lit(beyond)), F.lit(beyond)) - least
    held = intervals.filter(_overlaps(F.col(lower), F.col(upper))).withColumn("_low", low).withColumn("_high", high).filter("_low < _high")
    levels = max(1, -(-(beyond - least).bit_length() // _BITS))
    pieces = held.withColumn("_cell", F.explode(F.concat(*[_cells(level, levels) for level in range(levels)]))).drop("_low", "_high")
    used = sorted(r["level"] for r in pieces.select("_cell.level").distinct().collect())  # at most 16
    mine = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col("_code") - least, _BITS * k).alias("at")) for k in used])
    cells = coded.withColumn("_cell", F.explode(mine)).drop("_code")
    if totals is not None:
        cells = _summed(cells, "_cell", {name: F.col(name) for name in totals})
    return cells.join(pieces, "_cell").drop("_cell")


def _cells(level: int, levels: int) -> Column:
    """The interval's cells of one size: those wholly inside it that no larger cell inside it covers."""

    def inner(k: int) -> tuple[Column, Column]:
        size = (1 << _BITS * k) - 1
        return F.shiftright(F.col("_low") + size, _BITS * k), F.shiftright(F.col("_high"), _BITS * k)

    def span(first: Column, last: Column) -> Column:
        cells = F.transform(F.sequence(first, last - 1), lambda at: F.struct(F.lit(level).alias("level"), at.alias("at")))
        return F.when(first < last, cells).otherwise(F.array().cast("array<struct<level:int,at:bigint>>"))

    first, last = inner(level)
    if level == levels - 1:
        return span(first, last)
    up_first, up_last = inner(level + 1)
    ahead = span(first, F.least(last, F.shiftleft(up_first, _BITS)))
    behind = span(F.greatest(first, F.shiftleft(up_last, _BITS)), last)
    return F.when(up_first < up_last, F.concat(ahead, behind)).otherwise(span(first, last))


def with_band(
    rows: DataFrame, value: str, bands: DataFrame, lower: str, upper: str, carried: Sequence[str], index_rows: int = INDEX_ROWS
) -> DataFrame:
    """Rows with the columns ``carried`` of the band that holds their value; without one they keep NULLs.

    Bands must not overlap: a row of two bands would come twice. However many there are, only distinct values meet them beyond the index.
    """
    chosen = bands.select(F.col(lower).alias("_lower"), F.col(upper).alias("_upper"), *carried)
    if chosen.limit(index_rows + 1).count() <= index_rows:
        return _indexed(rows, value, chosen, "_lower", "_upper", "left").select(*rows.columns, *carried)
    values = rows.select(F.col(value).alias("_value")).distinct()
    met = interval_join(values, "_value", chosen, "_lower", "_upper", index_rows).select("_value", *carried)
    return rows.join(met, F.col(value) == F.col("_value"), "left").select(*rows.columns, *carried)
