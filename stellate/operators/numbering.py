"""Row positions, tiles and surrogate keys without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def with_position(df: DataFrame, order: Sequence[Column], position: str, total: str) -> DataFrame:
    """Adds the 0-based position in the given total order, and the row count.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    fixed in the shared folder; the partition sizes (one row per partition)
    then give each partition its offset. ``order`` must end in a unique column,
    which also lets a run of equal leading values spread over partitions.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy()).alias(total),
    )
    in_part = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(position, F.col("_offset") + in_part)
        .drop("_part", "_slot", "_offset")
    )


def with_tile(df: DataFrame, tiles: int, order: Sequence[Column], tile: str) -> DataFrame:
    """``ntile(tiles)`` over the whole frame: the first rows % tiles tiles hold one row more."""
    numbered = with_position(df, order, "_position", "_total")
    small = F.floor(F.col("_total") / tiles)
    longer = F.col("_total") % tiles
    edge = longer * (small + 1)
    at = F.col("_position")
    number = F.when(at < edge, F.floor(at / (small + 1))).otherwise(
        longer + F.floor((at - edge) / F.greatest(small, F.lit(1)))
    )
    return numbered.withColumn(tile, (number + 1).cast("int")).drop("_position", "_total")


def with_dense_key(members: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keys 1..n in sorted order over a set of any size whose ``order`` columns are unique."""
    numbered = with_position(members, [F.col(c) for c in order], "_position", "_total")
    return numbered.select(
        (F.col("_position") + 1).cast("long").alias(key), *[F.col(c) for c in members.columns]
    )


def hash_key(*natural: Column) -> Column:
    """A key computed from the natural key itself, so that the fact needs no join to get it."""
    return F.xxhash64(*natural)
