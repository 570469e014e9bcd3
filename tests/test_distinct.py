"""Mergeable distinct counts against COUNT(DISTINCT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellate.operators.distinct import distinct_keys, key_sets
from tests.conftest import rows_of


def test_sets_merge_to_the_count_of_any_coarser_grouping(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 4).alias("h"),
        F.when(F.col("id") % 13 > 0, F.col("id") * 37 % 90_001).alias("k"),  # keys over three bitmaps, some NULL
    )
    twice = df.unionByName(df)
    sets = key_sets(twice, ["g", "h"], "k")
    for by in (["g", "h"], ["g"], ["h"], []):
        want = df.groupBy(*by).agg(F.count_distinct("k").alias("n"))
        assert rows_of(distinct_keys(sets, by, "n").select(*by, "n")) == rows_of(want)


def test_no_keys(spark):
    df = spark.createDataFrame([("a", None)], "g string, k long")
    assert key_sets(df, ["g"], "k").count() == 0
    big = spark.createDataFrame([("a", 2**40), ("a", 2**40 + 1), ("a", 0), ("a", 2**40)], "g string, k long")
    assert rows_of(distinct_keys(key_sets(big, ["g"], "k"), ["g"], "n")) == [("a", 3)]
