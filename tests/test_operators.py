from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.functions.geo import cartesian_km
from stellate.operators import joins, nearest, numbering, periods
from stellate.operators.gates import GateFailed, counters, duplicate_keys, enforce, key_counters, side_by_side
from stellate.operators.nearest import nearest_target
from stellate.operators.shares import with_share
from stellate.operators.star import split_by_dimensions, totals_by_attribute, totals_by_label
from tests.conftest import rows_of


def skewed(spark, n=600):
    """A third of all rows on key 1, some on a missing key, the rest spread."""
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 != 0, F.col("id") % 50).cast("int").alias("k"),
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    rows = skewed(spark)
    lookup = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    plain = rows.join(lookup, "k", how).select("id", "k", "v")
    salted = joins.salted_join(rows, lookup, ["k"], ["id"], how, rows_per_task=20).select("id", "k", "v")
    assert rows_of(salted) == rows_of(plain)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()


def test_salted_join_matches_missing_parts_when_asked(spark):
    rows = skewed(spark)
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for limit in (20, 10**9):
        found = joins.salted_join(
            rows, sizes, ["k"], ["id"], rows_per_task=limit, null_safe=True,
            key_counts=sizes.withColumnRenamed("n", "count"),
        )
        expected = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
        assert rows_of(found.select("id", "k", "n")) == rows_of(expected.select("id", "k", "n"))


def test_flag_members_keeps_each_row_once(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    members = spark.createDataFrame([(1,), (1,), (3,), (9,)], "id long")
    flagged = joins.flag_members(rows, members, "id", "hit")
    assert rows_of(flagged) == [(1, True), (2, False), (3, True)]
    assert rows_of(joins.missing_keys(rows, members, "id")) == [(2,)]


@pytest.mark.parametrize(("n", "tiles"), [(0, 4), (3, 10), (10, 3), (100, 100), (257, 100)])
def test_tiles_equal_ntile(spark, n, tiles):
    df = spark.range(n).select("id", (F.col("id") % 3).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    expected = df.withColumn("t", F.ntile(tiles).over(Window.orderBy(*order)))
    found = numbering.with_tile(df.repartition(5), tiles, order, "t")
    assert rows_of(found.select("id", "v", "t")) == rows_of(expected)


@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 12))
@settings(max_examples=5, deadline=None)
def test_tiles_equal_ntile_for_any_input(spark, values, tiles):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int")
    order = [F.desc("v"), F.asc("id")]
    expected = df.withColumn("t", F.ntile(tiles).over(Window.orderBy(*order)))
    assert rows_of(numbering.with_tile(df, tiles, order, "t")) == rows_of(expected)


def test_positions_spread_one_hot_value_over_partitions(spark):
    """All rows share the leading value; the id tie-break still splits them."""
    df = spark.range(20000).select("id", F.lit(0).alias("v"))
    numbered = numbering.with_position(df, [F.desc("v"), F.asc("id")], "p", "n")
    wrong = numbered.filter((F.col("p") != F.col("id")) | (F.col("n") != 20000)).count()
    assert wrong == 0


def test_dense_keys_are_sorted_and_dense(spark):
    names = spark.createDataFrame([("b", 2), ("a", 9), ("b", 1)], "x string, y int")
    keyed = numbering.with_dense_key(names, "key", ["x", "y"])
    assert rows_of(keyed) == [(1, "a", 9), (2, "b", 1), (3, "b", 2)]


def km(a, b):
    p1, l1, p2, l2 = (math.radians(x) for x in (*a, *b))
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def brute(points, targets):
    out = {}
    for pid, plat, plon in points:
        if plat is None or plon is None:
            continue
        best = min(
            ((round(km((plat, plon), (tlat, tlon)), 6), tid) for tid, tlat, tlon in targets if tlat is not None and tlon is not None),
            default=None,
        )
        if best:
            out[pid] = best
    return out


def check_nearest(spark, points, targets, **options):
    schema = "{} long, latitude double, longitude double"
    found = nearest_target(
        spark.createDataFrame(points, schema.format("pid")),
        spark.createDataFrame(targets, schema.format("tid")),
        "pid", "tid", **options,
    )
    got = {r.pid: (r.distance_km, r.tid) for r in found.collect()}
    expected = brute(points, targets)
    assert got.keys() == expected.keys()
    for pid, (d, tid) in expected.items():
        assert got[pid][0] == pytest.approx(d, abs=2e-6), pid
        assert got[pid][1] == tid, pid


def scattered(rng, n, lat=(-90, 90), lon=(-180, 180)):
    return [(i, round(rng.uniform(*lat), 4), round(rng.uniform(*lon), 4)) for i in range(n)]


@pytest.mark.parametrize("bits", [5, 1], ids=["flat", "deep"])
def test_nearest_equals_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(nearest, "FANOUT_BITS", bits)
    rng = random.Random(7)
    points = scattered(rng, 150)
    # crowds, copies of one place, poles, both sides of the date line, gaps
    targets = scattered(rng, 25) + [(100 + i, 40.0 + i / 1000, -74.0) for i in range(20)]
    targets += [(200, 90.0, 0.0), (201, -90.0, 10.0), (202, 0.0, 180.0), (203, 0.0, -179.9), (204, 40.0, -74.0)]
    points += [(300 + i, 40.0, -74.0) for i in range(30)] + [(400, 89.9, 170.0), (401, 0.0, -180.0), (402, 0.0, 179.95)]
    points += [(500, None, 1.0), (501, 1.0, None)]
    targets += [(600, None, None)]
    check_nearest(spark, points, targets)


def test_two_far_cities_stay_far_below_all_pairs(spark):
    n = 20_000
    rng = [F.rand(s) / 5 for s in (1, 2, 3, 4)]
    here = ["latitude", "longitude"]

    def city(lat, lon, a, b):
        df = spark.range(n).select("id", (lat + a).alias("latitude"), (lon + b).alias("longitude"))
        x, y, z = cartesian_km(F.col("latitude"), F.col("longitude"))
        return df.withColumns({"_x": x, "_y": y, "_z": z})

    points = city(F.lit(40.0), F.lit(-74.0), rng[0], rng[1])
    order = [nearest._z_order(F.col("latitude"), F.col("longitude")), F.col("id")]
    sites = numbering.with_position(city(F.lit(48.0), F.lit(2.0), rng[2], rng[3]), order, "_position", "_total")
    leaves = nearest.reachable_leaves(points.select(*here, "_x", "_y", "_z"), sites, here)
    assert leaves.count() / n < 100 / 2**nearest.FANOUT_BITS * 8  # leaves of 32 targets each


def test_nearest_when_everything_is_far_away(spark):
    points = [(i, -40.0 + i / 10, 175.0) for i in range(20)]
    targets = [(1, 51.5, 0.0), (2, 48.9, 2.4)]
    check_nearest(spark, points, targets)


def test_nearest_ties_go_to_the_lowest_id(spark):
    check_nearest(spark, [(1, 10.0, 20.0)], [(7, 10.0, 21.0), (3, 10.0, 19.0), (5, 10.0, 21.0)])


def test_nearest_without_targets_is_empty(spark):
    empty = spark.createDataFrame([], "tid long, latitude double, longitude double")
    points = spark.createDataFrame([(1, 1.0, 1.0)], "pid long, latitude double, longitude double")
    assert nearest_target(points, empty, "pid", "tid").count() == 0


def test_totals_by_attribute_equals_join_then_group(spark):
    fact = spark.range(300).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    dim = spark.range(15).select(F.col("id").alias("k"), (F.col("id") % 3).alias("a"))
    parts = {"n": F.count(F.lit(1)), "v": F.sum("v")}
    found = totals_by_attribute(fact, dim, "k", ["a"], parts, members="keys")
    plain = fact.join(dim, "k").groupBy("a").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.count_distinct("k").alias("keys")
    )
    assert rows_of(found) == rows_of(plain)
    by_label = totals_by_label(fact, dim, "k", ["a"], parts)
    assert rows_of(by_label) == rows_of(plain.drop("keys"))


def test_one_scan_split_equals_union(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), (None, 1)], "a string, b int")
    found = split_by_dimensions(df, {"a": F.col("a"), "b": F.col("b")}, {"n": F.count(F.lit(1))})
    union = None
    for c in ("a", "b"):
        one = df.groupBy(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
        union = one if union is None else union.unionByName(one)
    assert rows_of(found) == rows_of(union)


def test_share_of_total_and_within(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 0)], "g string, k string, n long")
    assert [r.p for r in with_share(df, "n", "p", 1).orderBy("g", "k").collect()] == [25.0, 75.0, 0.0]
    within = with_share(df, "n", "p", 1, ["g"]).orderBy("g", "k").collect()
    assert [r.p for r in within] == [25.0, 75.0, None]


def test_to_date_restarts_and_trailing_counts_calendar_days(spark):
    days = spark.sql(
        "SELECT explode(sequence(DATE'2023-12-30', DATE'2024-01-02')) AS full_date"
    ).select("full_date", F.year("full_date").alias("year"), F.month("full_date").alias("month"), F.lit(1).alias("v"))
    got = days.select(
        "full_date",
        periods.to_date("v", "full_date", ["year", "month"]).alias("mtd"),
        periods.trailing_days("v", "full_date", 3).alias("t"),
        periods.running_total("v", "full_date").alias("r"),
    ).orderBy("full_date").collect()
    assert [(r.mtd, r.t, r.r) for r in got] == [(1, 1, 1), (2, 2, 2), (1, 3, 3), (2, 3, 4)]


def test_prior_year_at_day_grain_and_before_the_start(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2023-02-27', DATE'2024-03-01')) AS d").withColumn("v", F.dayofyear("d"))
    both = periods.with_prior_year(days, "d", ["v"], "_py").filter("d IN (DATE'2023-02-27', DATE'2024-02-29', DATE'2024-02-28')")
    assert {str(r.d): r.v_py for r in both.collect()} == {"2023-02-27": None, "2024-02-28": 59, "2024-02-29": 59}


def test_quiet_days_stay_in_the_calendar(spark):
    calendar = spark.createDataFrame([(1,), (2,), (3,)], "date_key int")
    fact = spark.createDataFrame([(1, 5), (3, 7), (3, 1)], "date_key int, v int")
    assert rows_of(periods.daily_totals(calendar, fact, {"v": F.sum("v")})) == [(1, 5), (2, 0), (3, 8)]


def test_change_from_previous_and_first(spark):
    df = spark.createDataFrame([(1, 100), (2, 50), (3, 150)], "m int, v int")
    got = df.select("m", periods.change_from_previous("v", "m").alias("p"), periods.change_from_first("v", "m").alias("g")).orderBy("m").collect()
    assert [(r.p, r.g) for r in got] == [(None, 50.0), (-50.0, 50.0), (200.0, 50.0)]


def test_gate_fails_on_any_counter(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    gate = counters(df, {"null_b": F.col("b").isNull(), "null_a": F.col("a").isNull()})
    with pytest.raises(GateFailed) as failure:
        enforce("gate", gate)
    assert failure.value.counters == {"null_b": 1}
    assert enforce("gate", gate, informational=["null_b"]) == {"null_b": 1, "null_a": 0}


def test_key_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert {r.k for r in duplicate_keys(df, "k").collect()} == {1, None}
    assert tuple(key_counters(df, "k").first()) == (1, 1)


def test_side_by_side(spark):
    a = spark.range(3).agg(F.count(F.lit(1)).alias("x"))
    b = spark.range(4).agg(F.count(F.lit(1)).alias("y"), F.max("id").alias("z"))
    assert [int(v) for v in side_by_side(a, b).first()] == [3, 4, 3]
