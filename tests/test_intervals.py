"""Interval joins against comparing every pair, by the index and by cells."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from stellate.operators.intervals import interval_join, with_band
from tests.conftest import rows_of


def pairs(values, intervals):
    return sorted(
        ((i, v, k, lo, hi) for i, v in enumerate(values) for k, (lo, hi) in enumerate(intervals) if v is not None and lo is not None and v >= lo and (hi is None or v < hi)),
        key=repr,
    )


def cents(x):
    return Decimal(x).scaleb(-2)


def numbers(seed):
    rng = random.Random(seed)
    values = [None if rng.random() < 0.05 else cents(rng.choice([500, rng.randint(-90000, 90000)])) for _ in range(400)]
    intervals = []
    for _ in range(90):
        lo = rng.randint(-95000, 95000)
        hi = lo + rng.choice([-5, 0, 1, 7, 300, 5000, 120000])
        intervals.append((None if rng.random() < 0.05 else cents(lo), None if rng.random() < 0.1 else cents(hi)))
    return values, intervals


@pytest.mark.parametrize("index_rows", [256, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_every_pair_and_no_other(spark, index_rows, seed):
    values, intervals = numbers(seed)
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v decimal(12,2)")
    held = spark.createDataFrame([(k, *b) for k, b in enumerate(intervals)], "k int, lo decimal(12,2), hi decimal(12,2)")
    out = interval_join(rows, "v", held, "lo", "hi", index_rows)
    assert rows_of(out.select("i", "v", "k", "lo", "hi")) == pairs(values, intervals)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("index_rows", [256, 0])
def test_other_types(spark, index_rows):
    first = date(2020, 1, 1)
    days = [first + timedelta(days=7 * i % 97) for i in range(60)] + [None]
    spans = [(first + timedelta(days=3 * i), None if i % 5 == 0 else first + timedelta(days=3 * i + i % 11)) for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(days)), "i int, v date")
    held = spark.createDataFrame([(k, *b) for k, b in enumerate(spans)], "k int, lo date, hi date")
    assert rows_of(interval_join(rows, "v", held, "lo", "hi", index_rows).select("i", "v", "k", "lo", "hi")) == pairs(days, spans)
    stamps = interval_join(
        rows.withColumn("v", F.col("v").cast("timestamp_ntz")), "v", held.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("lo", "hi")}), "lo", "hi", index_rows
    )
    assert sorted((r["i"], r["k"]) for r in stamps.collect()) == sorted((p[0], p[2]) for p in pairs(days, spans))
    # whole values against bounds with decimals
    whole = spark.createDataFrame([(i, i) for i in range(-5, 20)], "i int, v int")
    fine = spark.createDataFrame([(0, Decimal("2.5"), Decimal("7.5")), (1, Decimal("3.0"), Decimal("4.0"))], "k int, lo decimal(5,1), hi decimal(5,1)")
    got = sorted((r["i"], r["k"]) for r in interval_join(whole, "v", fine, "lo", "hi", index_rows).collect())
    assert got == [(3, 0), (3, 1), (4, 0), (5, 0), (6, 0), (7, 0)]


@pytest.mark.parametrize("index_rows", [256, 0])
def test_bands_keep_every_row_once(spark, index_rows):
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else cents(37 * i - 900)) for i in range(200)], "i int, v decimal(12,2)")
    cuts = [cents(c) for c in (0, 500, 501, 2000)]
    bands = spark.createDataFrame(list(zip("abcd", cuts, [*cuts[1:], None], strict=True)), "band string, lo decimal(12,2), hi decimal(12,2)")
    out = with_band(rows, "v", bands, "lo", "hi", ["band"], index_rows)
    want = [(i, v, next((b for b, lo, hi in zip("abcd", cuts, [*cuts[1:], None]) if v is not None and lo <= v and (hi is None or v < hi)), None)) for i, v in map(tuple, rows.collect())]
    assert rows_of(out) == sorted(want, key=repr)


@pytest.mark.parametrize("index_rows", [256, 0])
def test_nothing_meets_nothing(spark, index_rows):
    rows = spark.createDataFrame([(1, 5)], "i int, v long")
    held = spark.createDataFrame([(1, 0, 10)], "k int, lo long, hi long")
    assert interval_join(rows.limit(0), "v", held, "lo", "hi", index_rows).count() == 0
    assert interval_join(rows, "v", held.limit(0), "lo", "hi", index_rows).count() == 0
    assert with_band(rows, "v", held.limit(0), "lo", "hi", ["k"], index_rows).collect() == [(1, 5, None)]


def test_values_without_a_scale_of_whole_numbers_are_refused(spark):
    rows = spark.createDataFrame([(1, 0.5)], "i int, v double")
    held = spark.createDataFrame([(1, 0.0, 1.0)], "k int, lo double, hi double")
    with pytest.raises(ValueError, match="decimal"):
        interval_join(rows, "v", held, "lo", "hi", 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_by_cells(spark, seed):
    values, intervals = numbers(seed)
    check_sums(spark, values, intervals, 0)


def check_sums(spark, values, intervals, index_rows):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v decimal(12,2)")
    held = spark.createDataFrame([(k, *b) for k, b in enumerate(intervals)], "k int, lo decimal(12,2), hi decimal(12,2)")
    met = interval_join(rows, "v", held, "lo", "hi", index_rows, {"n": F.lit(1), "v": F.col("v"), "i": F.col("i")})
    assert met.columns == ["n", "v", "i", "k", "lo", "hi"]
    got = {r["k"]: (r["n"], r["v"], r["i"]) for r in met.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "v", "i")]).collect()}
    want = {}
    for i, v, k, _, _ in pairs(values, intervals):
        n, total, places = want.get(k, (0, 0, 0))
        want[k] = (n + 1, total + v, places + i)
    assert got == want


def rows_met(spark, monkeypatch, tmp_path, name, suppliers):
    """The query's result over 3,000 lines, checked, and how many rows its join returns."""
    prices = [None if i % 97 == 0 else 55400 + (i % 1500) * 37 / 100 for i in range(3000)]
    spark.createDataFrame(list(enumerate(prices)), "l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = [7, 7, 27, 11, None, *range(1000, 1000 + suppliers)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    met = []
    plain = interval_join
    monkeypatch.setattr("stellate.operators.intervals.interval_join", lambda *a: met.append(plain(*a)) or met[-1])
    got = {r["promotion"]: (r["n"], r["price"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    want = {}
    for k in keys:
        low = None if k is None else k * 7919 % 90000
        held = [] if k is None else [Decimal(f"{p:.2f}") for p in prices if p is not None and p >= low and (k % 20 == 7 or p < low + 400 + k % 300)]
        if held:
            n, total = want.get(k, (0, 0))
            want[k] = (n + len(held), total + sum(held))
    assert got == want and sum(n for n, _ in want.values()) > 3000
    return met[0].count()


def test_promotions_by_cells_meet_sums_not_lines(spark, monkeypatch, tmp_path):
    assert rows_met(spark, monkeypatch, tmp_path, "j5_promotions_by_cells", 2) < 500


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_by_segments(spark, seed):
    values, intervals = numbers(seed)
    check_sums(spark, values, intervals, 256)
    check_sums(spark, [], intervals, 256)
    check_sums(spark, values, [], 256)


@pytest.mark.parametrize("suppliers", [3, 300])  # by segments and by cells
def test_promotions_that_overlap_meet_sums_not_lines(spark, monkeypatch, tmp_path, suppliers):
    assert rows_met(spark, monkeypatch, tmp_path, "j5_promotions_that_overlap", suppliers) < 500 + 30 * suppliers
