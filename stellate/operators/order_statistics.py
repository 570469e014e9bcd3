"""Exact tiles and quantiles without ordering the rows.

Rows are reduced to counts per distinct value, before any shuffle. Distinct values lie in ranges, hot groups over as many as they
need, and prefix sums over them place every value. That names the few values at which a tile ends or a quantile lies;
rows are compared with these, and only rows whose value itself is cut by a tile's end are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.functions.literals import steps_passed, typed_literal
from stellate.session import cut_lineage


def with_prefix_sum(rows: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str, before: str, total: str) -> DataFrame:
    """Adds, inside each group of ``by`` (none: all rows), the sum of ``weight`` over the rows ahead in ``order``, and over all.

    ``order`` has to be total inside a group. Rows are range-partitioned by group and order, so a group may span any number of
    tasks; one row per group and task carries the sums onwards. NULL is a group like any other.
    """
    group = [F.col(c) for c in by]
    placed = cut_lineage(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_part").agg(F.sum(weight).alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_g_{c}") for c in by], F.col("_part").alias("_g_part"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"), F.sum("_sum").over(Window.partitionBy(*by)).alias(total),
    )
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by], F.col("_part") == F.col("_g_part"))
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, same)
        .withColumn(before, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_inside", "_g_part", "_offset", *[f"_g_{c}" for c in by])
    )


def quantile(df: DataFrame, by: Sequence[str], value: str, share: float, out: str) -> DataFrame:
    """One row per group of ``by``: the exact, interpolated quantile of a numeric column of any range, as a double.

    NULL values don't count; a group of nothing else has a NULL quantile. Without ``by`` the one row is that of all rows.
    """
    counts = df.groupBy(*by, value).agg(F.count(value).alias("_n"))
    placed = with_prefix_sum(counts, by, [F.asc(value)], "_n", "_before", "_total")
    at = F.lit(share) * (F.col("_total") - 1)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    number = F.col(value).cast("double")
    ends = placed.filter(holds(low) | holds(high) | F.col(value).isNull()).select(
        *by, F.when(holds(low), number).alias("_low"), F.when(holds(high), number).alias("_high"), (at - low).alias("_way")
    )
    met = ends.groupBy(*by).agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_way").alias("_way"))
    return met.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_way")).alias(out))


def _tile_at(position: Column, total: Column, tiles: int) -> Column:
    """The tile of a 0-based position: the first total % tiles tiles hold one row more."""
    small, longer = F.floor(total / tiles), total % tiles
    edge = longer * (small + 1)
    return 1 + F.when(position < edge, F.floor(position / (small + 1))).otherwise(
        longer + F.floor((position - edge) / F.greatest(small, F.lit(1)))
    )


def with_tile_by_value(df: DataFrame, tiles: int, value: str, tie: str, tile: str, descending: bool = False) -> DataFrame:
    """``ntile(tiles)`` by ``value`` and, among equal values, by the unique column ``tie``; NULL values first, or last if descending.

    At most tiles - 1 values, those on which a later tile begins, are read back; each row finds its tile by comparing with them. Rows of
    a value that a tile's end cuts, however many they are, are numbered by ``tie`` alone, in ranges. ``df`` is read three times.
    """
    order = F.desc(value) if descending else F.asc(value)
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_prefix_sum(counts, [], [order], "_n", "_before", "_total")
    first = _tile_at(F.col("_before"), F.col("_total"), tiles)
    last = _tile_at(F.col("_before") + F.col("_n") - 1, F.col("_total"), tiles)
    # a value matters if a tile begins in it or at it: its first tile is not that of the row ahead, or not its last one
    ahead = _tile_at(F.col("_before") - 1, F.col("_total"), tiles)
    starts = placed.select(value, "_before", "_total", first.alias("_first"), last.alias("_last"), F.when(F.col("_before") > 0, ahead).otherwise(1).alias("_ahead"))
    edges = starts.filter((F.col("_first") != F.col("_last")) | (F.col("_first") != F.col("_ahead"))).collect()  # at most tiles - 1
    here, kind = F.col(value), df.schema[value].dataType
    edges.sort(key=lambda e: e["_before"])
    known = [e for e in edges if e[value] is not None]
    null = next((e for e in edges if e[value] is None), None)
    passed = steps_passed(value, [e[value] for e in known], kind, descending)  # edges at or before the row's value
    pick = lambda values: F.element_at(F.expr(f"array({', '.join(values)})"), F.col("_passed") + 1)
    numbers = lambda values: pick([str(v) for v in values])

    # tiles of rows behind each edge, and of rows whose value is an edge's own, unless the edge cuts it: 0
    base = null["_last"] if null is not None and not descending else 1
    behind = [base, *[e["_last"] for e in known]]
    own = [0, *[e["_first"] if e["_first"] == e["_last"] else 0 for e in known]]
    edge_values = [typed_literal(e[value], kind) for e in known]
    on_edge = (F.col("_passed") > 0) & (here == pick([*edge_values[:1], *edge_values])) if known else F.lit(False)
    number = F.when(on_edge, numbers(own)).otherwise(numbers(behind))
    of_null = (0 if null["_first"] != null["_last"] else null["_first"]) if null is not None else behind[-1] if descending else 1
    marked = df.withColumn("_passed", passed).withColumn(tile, F.when(here.isNull(), of_null).otherwise(number).cast("int"))
    cut = [e for e in edges if e["_first"] != e["_last"]]
    if not cut:
        return marked.drop("_passed")
    rows = with_prefix_sum(marked.filter(F.col(tile) == 0).withColumn("_one", F.lit(1)), [value], [F.asc(tie)], "_one", "_at", "_of")
    begins = F.when(here.isNull(), F.lit(null["_before"] if null is not None else 0)).otherwise(numbers([0, *[e["_before"] for e in known]]))
    numbered = rows.withColumn(tile, _tile_at(begins + F.col("_at"), F.lit(cut[0]["_total"]), tiles).cast("int"))
    return marked.filter(F.col(tile) > 0).drop("_passed").unionByName(numbered.select(*df.columns, tile))
