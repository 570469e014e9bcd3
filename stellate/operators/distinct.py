"""Exact distinct counts that merge: bitmaps per group, stored once and united for any coarser grouping.

For keys that are dense numbers, such as the surrogate keys of ``numbering.with_dense_key``: a bitmap covers 32,768 keys in 4 KB.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_sets(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """One row (by, key_bucket, key_bits) per group and range of keys that it has any of; NULL keys belong to no set.

    Bits are set before the shuffle, so a group or key with a third of all rows costs a bitmap per task.
    """
    known = rows.filter(F.col(key).isNotNull()).withColumn("key_bucket", F.bitmap_bucket_number(F.col(key)))
    return known.groupBy(*by, "key_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias("key_bits"))


def distinct_keys(sets: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """COUNT(DISTINCT key) per group of ``by``, any of the columns that the sets were made by. No key is shuffled again."""
    united = sets.groupBy(*by, "key_bucket").agg(F.bitmap_or_agg("key_bits").alias("_bits"))
    return united.groupBy(*by).agg(F.sum(F.bitmap_count("_bits")).alias(out))
