from __future__ import annotations

import datetime
import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stellate.functions import bands, calendar, geo, rates, text
from stellate.functions.literals import literal_map, literal_table


def one(spark, value, schema, *columns):
    return spark.createDataFrame([(value,)], schema).select(*columns).first()


@pytest.mark.parametrize(
    ("raw", "amount"), [("$-77.00", "-77.00"), ("$12.34", "12.34"), ("$0.00", "0.00"), (None, None)]
)
def test_money(spark, raw, amount):
    found = one(spark, raw, "v string", text.money(F.col("v")))[0]
    assert found == (None if amount is None else decimal.Decimal(amount))


def test_malformed_money_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, "$12,x", "v string", text.money(F.col("v")))


@pytest.mark.parametrize(("raw", "number"), [("58523.0", 58523), ("58523.6", 58524), ("0.5", 1), (None, None)])
def test_whole_number_rounds(spark, raw, number):
    assert one(spark, raw, "v string", text.whole_number(F.col("v")))[0] == number


@pytest.mark.parametrize(
    ("raw", "items"), [("a,b", ["a", "b"]), ("a, b", ["a", " b"]), ("", []), (None, None), ("a", ["a"])]
)
def test_comma_list(spark, raw, items):
    assert one(spark, raw, "v string", text.comma_list(F.col("v")))[0] == items


def test_flags_sentinels_words_months(spark):
    df = spark.createDataFrame([("Y",), ("N",), ("?",), (None,)], "v string")
    assert [r[0] for r in df.select(text.yes_no(F.col("v"))).collect()] == [True, False, None, None]
    assert one(spark, "-999", "v string", text.absent(F.col("v"), "-999"))[0] is None
    assert one(spark, "Chip Transaction", "v string", text.first_word(F.col("v")))[0] == "Chip"
    assert one(spark, "07/2019", "v string", text.month_year(F.col("v")))[0] == datetime.date(2019, 7, 1)


@pytest.mark.parametrize(
    ("day", "iso", "sunday0"),
    [("2024-01-07", 7, 0), ("2024-01-08", 1, 1), ("2024-01-13", 6, 6)],
)
def test_three_weekday_numberings(spark, day, iso, sunday0):
    d = F.to_date("v")
    got = one(spark, day, "v string", calendar.iso_weekday(d), calendar.sunday_zero_weekday(d), F.dayofweek(d))
    assert tuple(got) == (iso, sunday0, sunday0 + 1)


def test_generated_calendar_is_whole(spark):
    days = calendar.generated_calendar(spark, "2010-01-01", "2019-12-31")
    assert days.count() == 3652
    leap = days.filter("date_key = 20160229").first()
    assert (leap.day_name, leap.month_name, leap.is_weekend, leap.quarter) == ("Monday", "February", False, 1)
    assert leap.month_start == datetime.date(2016, 2, 1)


def test_harvested_calendar_has_only_days_in_use(spark):
    df = spark.createDataFrame([("2024-01-07",), ("2024-01-07",), ("2024-03-01",)], "d string").select(
        F.to_date("d").alias("d")
    )
    days = calendar.harvested_calendar(df, "d").orderBy("date_key").collect()
    assert [(r.date_key, r.day_of_week) for r in days] == [(20240107, 0), (20240301, 5)]


@pytest.mark.parametrize(
    ("value", "label", "key"),
    [
        ("0.00", "Under $25", 1), ("24.99", "Under $25", 1), ("25.00", "$25-100", 2), ("100.00", "$100-250", 3),
        ("250.00", "$250-500", 4), ("499.99", "$250-500", 4), ("500.00", "$500+", 5), (None, "$500+", None),
        ("-0.01", "Under $25", None),
    ],
)
def test_ticket_band_edges(spark, value, label, key):
    amount = None if value is None else decimal.Decimal(value)
    got = one(spark, amount, "v decimal(12,2)", bands.TICKET.label(F.col("v")), bands.TICKET.key(F.col("v")))
    assert tuple(got) == (label, key)


@given(st.lists(st.integers(-10, 1000), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_label_and_order_agree(spark, values):
    for scale in (bands.AGE, bands.CREDIT, bands.DISTANCE, bands.DEBT_TO_INCOME):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        for label, order in df.select(scale.label(F.col("v")), scale.order(F.col("v"))).collect():
            assert scale.labels[order - 1] == label


def test_scale_checks_itself():
    with pytest.raises(ValueError):
        bands.Scale((2, 1), ("a", "b", "c"))
    with pytest.raises(ValueError):
        bands.Scale((1, 2), ("a", "b"))


def test_band_table_has_open_end(spark):
    rows = bands.TICKET.as_table(spark, "ticket_band").orderBy("ticket_band_key").collect()
    assert len(rows) == 5 and rows[0].lower_bound == 0 and rows[-1].upper_bound is None
    assert [r.upper_bound for r in rows[:-1]] == [r.lower_bound for r in rows[1:]]


def test_rates_round_half_up_and_guard_zero(spark):
    df = spark.createDataFrame([(1, 16), (1, 0), (5, 1000), (0, 3)], "a long, b long")
    got = [r[0] for r in df.select(rates.percent(F.col("a"), F.col("b"), 1)).collect()]
    assert got == [6.3, None, 0.5, 0.0]
    assert df.select(rates.ratio(F.col("a"), F.col("b"))).collect()[1][0] is None


def test_sum_where_is_null_without_rows(spark):
    df = spark.createDataFrame([(1, False)], "a long, f boolean")
    assert df.agg(rates.sum_where(F.col("a"), F.col("f"))).first()[0] is None


def test_median_rounds_the_half_step_up(spark):
    df = spark.createDataFrame([(decimal.Decimal("16.4"), 1), (decimal.Decimal("16.5"), 1), (None, 5)], "v decimal(10,1), n long")
    assert df.agg(rates.median_tenths(F.col("v"), F.col("n"))).first()[0] == 16.5
    assert df.union(df.limit(1)).agg(rates.median_tenths(F.col("v"), F.col("n"))).first()[0] == 16.4
    more = df.withColumn("n", F.when(F.col("v") == 16.4, 2).otherwise(1))
    assert more.agg(rates.median_tenths(F.col("v"), F.col("n"))).first()[0] == 16.4


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (0.0, 179.5, 0.0, -179.5), (10.0, 5.0, 10.0, 5.0)], "a double, b double, c double, d double")
    half, across, same = (r[0] for r in df.select(geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect())
    assert half == pytest.approx(6371 * 3.141592653589793)
    assert across == pytest.approx(111.19, abs=0.01)
    assert same == 0


def test_literal_table_and_map(spark):
    rows = [(1, "it's", True, None), (2, "a\\b", False, 3)]
    df = literal_table(spark, rows, "k short, t string, f boolean, n int")
    assert [tuple(r) for r in df.collect()] == rows
    assert df.dtypes == [("k", "smallint"), ("t", "string"), ("f", "boolean"), ("n", "int")]
    assert spark.range(1).select(literal_map([("x", 1), ("y's", 2)])["y's"]).first()[0] == 2
