"""Data-quality gates: one row of counters that must all be zero."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateFailed(RuntimeError):
    def __init__(self, gate: str, counters: dict[str, object]):
        super().__init__(f"{gate}: {counters}")
        self.counters = counters


def counters(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One pass, one row: how many rows break each check."""
    return rows.agg(*[F.count_if(check).alias(name) for name, check in checks.items()])


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One-row aggregates as the columns of one row."""
    tagged = [
        f.select(F.create_map(*[x for c in f.columns for x in (F.lit(c), F.col(c).cast("decimal(38,2)"))]).alias("m"))
        for f in one_row_frames
    ]
    names = [c for f in one_row_frames for c in f.columns]
    stacked = reduce(DataFrame.unionByName, tagged)
    values = [F.max(F.try_element_at("m", F.lit(n))).alias(n) for n in names]
    return stacked.agg(*values)


def enforce(gate: str, result: DataFrame, informational: Sequence[str] = ()) -> dict[str, object]:
    """Fail the layer if any counter is not zero. Reads the one row of counters back."""
    row = result.first().asDict()
    broken = {k: v for k, v in row.items() if k not in informational and (v is None or v != 0)}
    if broken:
        raise GateFailed(gate, broken)
    return row


def enforce_rows(gate: str, result: DataFrame, name: str) -> None:
    """Fail the layer if any counter of any row is not zero. One row per checked table, called ``name``."""
    broken = {
        f"{row[name]}.{k}": v for row in result.collect() for k, v in row.asDict().items() if k != name and v != 0
    }
    if broken:
        raise GateFailed(gate, broken)


def duplicate_keys(table: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once or hold a NULL; must be empty."""
    null_part = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return table.groupBy(*key).count().filter((F.col("count") > 1) | null_part)


def key_counters(table: DataFrame, *key: str) -> DataFrame:
    """Duplicate keys and NULL keys as counters."""
    null_part = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return (
        table.groupBy(*key)
        .count()
        .agg(
            F.count_if((F.col("count") > 1) & ~null_part).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(null_part, F.col("count"))), F.lit(0)).alias("null_keys"),
        )
    )


def row_total(table: DataFrame, name: str) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias(name))


def missing_counts(uses: DataFrame, known: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row: per kind of key how many rows use one that is not known.

    ``uses`` and ``known`` are (kind, key) rows, of all kinds together, so that one scan and one shuffle serve every kind;
    ``names`` gives each kind its counter. A use without a key counts as unknown.
    """
    per_key = uses.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    unknown = per_key.join(known.select("kind", "key").distinct(), ["kind", "key"], "left_anti")
    return unknown.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name) for kind, name in names.items()])
