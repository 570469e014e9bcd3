"""Joins that keep their shape when a key is hot.

Whether a lookup is small enough to broadcast is left to Spark, which knows the size of written tables;
beyond that AQE splits the rows of a hot key. ``salted_join`` is for plans that AQE cannot split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 4_000_000


def _join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str, null_safe: bool) -> DataFrame:
    """Equi-join; ``null_safe`` lets missing key parts match each other."""
    if not null_safe:
        return rows.join(lookup, on, how)
    renamed = lookup.withColumnsRenamed({k: f"_lookup_{k}" for k in on})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_lookup_{k}")) for k in on])
    return rows.join(renamed, match, how).drop(*[f"_lookup_{k}" for k in on])


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "left",
    key_counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join in which a hot key's rows are spread over as many tasks as they need.

    Only keys above ``rows_per_task`` are salted: their lookup rows are copied
    once per salt, all others once; with no such key it is a plain join. At
    most total / rows_per_task keys can be hot, which bounds the broadcast
    list. ``salt_by`` names columns that tell the rows of one key apart.
    ``key_counts`` (keys + ``count``) saves the counting pass where the caller
    already has it.
    """
    on = list(on)
    counts = key_counts if key_counts is not None else rows.groupBy(*on).count()
    hot = counts.filter(F.col("count") > rows_per_task).select(
        *on, F.ceil(F.col("count") / rows_per_task).cast("int").alias("_salts")
    )
    if hot.isEmpty():
        return _join(rows, lookup, on, how, null_safe)
    salts = F.coalesce(F.col("_salts"), F.lit(1))

    def with_salts(df: DataFrame) -> DataFrame:
        marks = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in on], "_salts")
        match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(marks[f"_hot_{k}"]) for k in on])
        return df.join(F.broadcast(marks), match, "left").drop(*[f"_hot_{k}" for k in on])

    spread = (
        with_salts(rows)
        .withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), salts).cast("int"))
        .drop("_salts")
    )
    copies = (
        with_salts(lookup)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return _join(spread, copies, [*on, "_salt"], how, null_safe).drop("_salt")


def flag_members(rows: DataFrame, members: DataFrame, on: str, flag: str) -> DataFrame:
    """Semi-join as a column: true where the key occurs in members, each row kept once.

    ``on`` is the row id of ``rows``, so its join keys are spread evenly; members are
    reduced to their distinct ids before the shuffle, however often one occurs.
    """
    marks = members.select(on).distinct().withColumn(flag, F.lit(True))
    return rows.join(marks, on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def missing_keys(rows: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Distinct keys that have no lookup row. Reduced before the anti join."""
    return rows.select(on).distinct().join(lookup.select(on), on, "left_anti")
