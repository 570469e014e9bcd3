"""Star-join reports that aggregate before they join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_by_label(
    fact: DataFrame,
    dimension: DataFrame,
    key: str,
    labels: Sequence[str],
    parts: Mapping[str, Column],
) -> DataFrame:
    """Totals per label of a dimension whose key domain is fixed (days, codes, channels, bands, reasons).

    Such a dimension may always be broadcast, and joining it first leaves one
    row per label and task to shuffle instead of one per key and task.
    """
    joined = fact.join(F.broadcast(dimension.select(key, *labels)), key)
    return joined.groupBy(*labels).agg(*[agg.alias(name) for name, agg in parts.items()])


def totals_by_attribute(
    fact: DataFrame,
    dimension: DataFrame,
    key: str,
    attributes: Sequence[str],
    parts: Mapping[str, Column],
    members: str | None = None,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Additive totals per attribute of a dimension that grows with the data (clients, cards, products).

    The fact is first reduced to one row per key (combined map-side, so a hot
    key costs one row per task), and only then meets the dimension. ``members``
    names a column that counts distinct keys; ``extra`` holds aggregates over
    the joined per-key rows.
    """
    per_key = fact.groupBy(key).agg(*[agg.alias(name) for name, agg in parts.items()])
    joined = per_key.join(dimension, key)
    aggs = [F.sum(name).alias(name) for name in parts]
    if members:
        aggs.append(F.count(F.lit(1)).alias(members))
    aggs += [agg.alias(name) for name, agg in (extra or {}).items()]
    return joined.groupBy(*attributes).agg(*aggs)


def split_by_dimensions(
    rows: DataFrame, segments: Mapping[str, Column], parts: Mapping[str, Column]
) -> DataFrame:
    """The same totals for several dimensions in one scan, tagged with the dimension name.

    Rows are reduced to one per combination of segments before they are copied
    once per dimension.
    """
    combined = rows.groupBy(*[c.alias(name) for name, c in segments.items()]).agg(
        *[agg.alias(name) for name, agg in parts.items()]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("segment"))
            for name in segments
        ]
    )
    return (
        combined.select(F.explode(pairs).alias("pair"), *parts)
        .groupBy("pair.dimension", "pair.segment")
        .agg(*[F.sum(name).alias(name) for name in parts])
    )
