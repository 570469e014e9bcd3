"""Tiles and quantiles against Spark's own, on values that repeat, are NULL, have any range, and fill one group."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.operators.order_statistics import quantile, with_prefix_sum, with_tile_by_value
from tests.conftest import rows_of


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, v decimal(12,2)").repartition(5)


def cases():
    rng = random.Random(4)
    d = lambda x: None if x is None else Decimal(x).quantize(Decimal("0.01"))
    return {
        "distinct": [d(x) for x in rng.sample(range(-10**6, 10**6), 700)],
        "hot": [d(5)] * 300 + [d(rng.randint(0, 40)) for _ in range(600)],
        "nulls": [None if i % 3 == 0 else d(rng.randint(0, 9)) for i in range(500)],
        "equal": [d(1)] * 250,
        "all null": [None] * 30,
        "few": [d(3), d(1), d(2)],
        "one": [d(7)],
        "none": [],
    }


@pytest.mark.parametrize("name", cases())
@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("tiles", [1, 7, 100])
def test_tiles_equal_ntile(spark, name, descending, tiles):
    df = frame(spark, cases()[name])
    order = [F.desc("v") if descending else F.asc("v"), F.asc("id")]
    want = df.withColumn("tile", F.ntile(tiles).over(Window.orderBy(*order)))
    assert rows_of(with_tile_by_value(df, tiles, "v", "id", "tile", descending)) == rows_of(want)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_equal_percentile(spark, share):
    rows = [(name if name != "few" else None, v) for name, values in cases().items() for v in values]
    df = spark.createDataFrame(rows, "g string, v decimal(12,2)").repartition(7)
    want = df.groupBy("g").agg(F.percentile("v", share).alias("q"))
    got = {r["g"]: r["q"] for r in quantile(df, ["g"], "v", share, "q").collect()}
    assert set(got) == {r["g"] for r in want.collect()}
    for r in want.collect():
        assert got[r["g"]] == (None if r["q"] is None else pytest.approx(r["q"], abs=1e-9))
    assert quantile(df, [], "v", share, "q").first()["q"] == pytest.approx(df.agg(F.percentile("v", share)).first()[0], abs=1e-9)


def test_a_hot_group_spans_many_tasks(spark):
    """A group with most rows and any number of distinct values is placed in pieces, not in one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"), (F.col("id") * 7919 % 4001).alias("v"), F.lit(1).alias("n"))
        out = with_prefix_sum(df, ["g"], [F.asc("v")], "n", "before", "total")
        want = df.withColumn("before", F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1).withColumn("total", F.count("*").over(Window.partitionBy("g")))
        assert rows_of(out.select("g", "v", "n", "before", "total")) == rows_of(want)
        pieces = df.repartitionByRange("g", "v").withColumn("p", F.spark_partition_id()).filter("g = 0").select("p").distinct().count()
        assert pieces > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_are_ordered_only_at_a_cut_value(spark):
    df = frame(spark, cases()["distinct"])
    plan = with_tile_by_value(df, 10, "v", "id", "tile")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Join" not in plan
