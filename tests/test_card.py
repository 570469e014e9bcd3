"""The card flow on a small hand-written portfolio with one row per awkward case."""

from __future__ import annotations

import decimal

import pytest
from pyspark.sql import functions as F

from stellate.operators.gates import GateFailed, enforce
from stellate.plans import card_measures as measures
from stellate.plans import card_reports as reports
from stellate.plans import card_warehouse as cw
from stellate.sources import publish, schemas
from tests.conftest import rows_of

#  id, date, client, card, amount, chip, merchant, city, state, zip, mcc, errors
TRANSACTIONS = [
    ("1", "2017-01-01 08:15:00", "1", "10", "$-77.00", "Chip Transaction", "5", "Rome", "Italy", None, "3722", None),
    ("2", "2017-01-02 17:00:00", "1", "10", "$12.34", "Online Transaction", "5", "ONLINE", None, None, "4900",
     "Bad Card Number, Bad Expiration,Insufficient Balance"),
    ("3", "2017-01-04 19:59:00", "2", "20", "$0.00", "Swipe Transaction", "6", "Austin", "TX", "58523.0", "4829", None),
    ("4", "2016-12-31 23:00:00", "2", "21", "$500.00", "Swipe Transaction", "5", "Austin", "TX", "58523.0", "5812", "Bad PIN"),
    ("5", "2017-01-04 03:00:00", "2", "20", "$499.99", "Online Transaction", "5", "Austin", "TX", "58524.0", "9999", "Technical Glitch"),
    ("6", "2017-01-05 03:00:00", "1", "11", "$25.00", "Chip Transaction", "7", "Austin", "TX", "58523.0", "3999", ""),
]
LABELS = [("1", "No"), ("2", "Yes"), ("3", "No"), ("5", "Yes")]
USERS = [
    ("1", "34", "65", "1980", "1", "F", "a", "1.5", "2.5", "$100", "$0", "$10", "579", "2"),
    ("2", "65", "66", "1980", "1", "M", "b", "1.5", "2.5", "$100", "$40000", "$40000", "800", "2"),
]
CARDS = [
    ("10", "1", "Visa", "Credit", "07/2019", "YES", "1", "$4999", "01/2010", "No"),
    ("11", "1", "Visa", "Debit", "07/2019", "NO", "1", "$5000", "01/2010", "No"),
    ("20", "2", "Amex", "Credit", "07/2019", "YES", "1", "$30000", "01/2010", "No"),
    ("21", "2", "Amex", "Debit (Prepaid)", "07/2019", "YES", "1", "$64", "01/2010", "No"),
]
MCC = [("3722", "rail"), ("4900", "utility"), ("4829", "wires"), ("5812", "food"), ("9999", "other"), ("3999", "range")]


ALL_REPORTS = [
    f for name, f in vars(reports).items()
    if callable(f) and f.__module__ == reports.__name__ and not name.startswith("_") and name != "error_mix_side_by_side"
]


def warehouse(spark, transactions=TRANSACTIONS, labels=LABELS, users=USERS, cards=CARDS, mcc=MCC):
    frames = {
        "transactions": spark.createDataFrame(transactions, schemas.TRANSACTIONS),
        "fraud_labels": spark.createDataFrame(labels, schemas.FRAUD_LABELS),
        "users": spark.createDataFrame(users, schemas.USERS),
        "cards": spark.createDataFrame(cards, schemas.CARDS),
        "mcc": spark.createDataFrame(mcc, schemas.MCC),
    }
    return cw.CardWarehouse(spark, frames.__getitem__)


@pytest.fixture(scope="module")
def wh(spark):
    return warehouse(spark)


def by_id(df, key="transaction_id"):
    return {getattr(r, key): r for r in df.collect()}


def test_staging(wh):
    t = by_id(wh.transactions)
    assert t[1].amount == decimal.Decimal("-77.00") and t[1].zip is None and t[3].zip == 58523
    assert t[2].error_list == ["Bad Card Number", " Bad Expiration", "Insufficient Balance"]
    assert (t[1].is_failed, t[6].is_failed, t[6].error_list) == (False, True, [])
    assert (t[4].has_fraud_label, t[4].is_fraud, t[1].is_fraud, t[2].is_fraud) == (False, None, False, True)
    assert (t[2].is_online, t[5].is_online, t[5].merchant_city) == (True, True, "Austin")


def test_clients_and_cards(wh):
    c = by_id(wh.dim_client, "client_id")
    assert c[1].debt_to_income is None and c[1].dti_band == "3x+"
    assert (c[1].age_band, c[2].age_band, c[1].credit_band, c[2].credit_band) == (
        "Under 35", "65+", "Poor (<580)", "Exceptional (800+)")
    assert (c[1].income_band, c[2].income_band, c[2].dti_band) == ("Under $40k", "$40-60k", "1-2x")
    cards = by_id(wh.dim_card, "card_id")
    assert [cards[k].limit_band for k in (10, 11, 20)] == ["Under $5k", "$5-15k", "$30k+"]
    assert str(cards[10].expires_on) == "2019-07-01" and cards[11].has_chip is False


@pytest.mark.parametrize(
    ("mcc", "category"),
    [
        (3722, "Transport & Travel"), (3780, "Utilities & Telecom"), (3999, "Home & Trade Supplies"),
        (3000, "Home & Trade Supplies"), (2999, "General Retail & Apparel"), (4000, "General Retail & Apparel"),
        (7349, "Home & Trade Supplies"), (None, "General Retail & Apparel"),
    ],
)
def test_spend_category(spark, mcc, category):
    df = spark.createDataFrame([(mcc,)], "mcc int")
    assert df.select(cw.spend_category(F.col("mcc"))).first()[0] == category


def test_location(wh):
    places = {(r.city, r.state, r.zip): r for r in wh.dim_location.collect()}
    assert set(places) == {("Rome", "Italy", -1), ("ONLINE", "", -1), ("Austin", "TX", 58523), ("Austin", "TX", 58524)}
    online, rome, austin = places["ONLINE", "", -1], places["Rome", "Italy", -1], places["Austin", "TX", 58523]
    assert (online.country, online.is_domestic, online.is_online) == (None, None, True)
    assert (rome.country, rome.is_domestic) == ("Italy", False)
    assert (austin.country, austin.is_domestic) == ("United States", True)


def test_fact_and_bridge(wh):
    f = by_id(wh.fact)
    assert (f[1].abs_amount, f[1].is_refund, f[3].is_zero_auth) == (decimal.Decimal("77.00"), True, True)
    assert [f[i].ticket_band_key for i in range(1, 7)] == [2, 1, 1, 5, 4, 2]
    assert [f[i].channel_key for i in (1, 2, 3)] == [1, 3, 2]
    assert f[4].is_fraud is False and f[4].has_fraud_label is False
    assert rows_of(wh.bridge) == [(2, 1), (2, 4), (2, 5), (4, 2), (5, 3)]


def test_window_and_calendar(wh):
    assert {r.transaction_id for r in wh.window_fact.collect()} == {1, 2, 3, 5, 6}
    days = [str(r.full_date) for r in wh.window_calendar.orderBy("date_key").collect()]
    assert days == [f"2017-01-0{i}" for i in range(1, 6)]


def test_fan_out_against_once_per_transaction(wh):
    per_error = reports.failures_by_error(wh).collect()
    assert sum(r.occurrences for r in per_error) == 4
    total = measures.evaluate(wh, ["failed_transactions", "issuer_owned_failed_value"]).first()
    assert total.failed_transactions == 3
    assert total.issuer_owned_failed_value == decimal.Decimal("512.33")
    stale = measures.evaluate(wh, ["stale_credential_transactions", "cards_with_stale_credential"]).first()
    assert tuple(stale) == (1, 1)


def test_rates_divide_by_labelled_rows(wh):
    row = reports.label_coverage(wh).first()
    assert (row.all_rows, row.labelled_rows, row.fraud_rows) == (5, 4, 2)
    assert (row.label_coverage_pct, row.fraud_rate_pct, row.wrong_denominator_pct) == (80.0, 50.0, 40.0)


def test_rollup_total_comes_first(wh):
    rows = reports.stale_declines_by_category(wh).collect()
    assert (rows[0].spend_category, rows[0].is_total, rows[0].stale_credential_declines, rows[0].cards_affected) == (None, 1, 2, 1)


def test_utilisation_is_credit_cards_only(wh):
    rows = {r.limit_band: r for r in reports.utilisation_by_limit_band(wh).collect()}
    assert set(rows) == {"Under $5k", "$30k+"} and rows["Under $5k"].avg_limit == 4999


def test_empty_groups_have_no_rate(wh):
    row = measures.evaluate(wh, ["fraud_rate", "avg_fraud_ticket", "transactions"], where=F.col("transaction_id") == 6).first()
    assert tuple(row) == (None, None, 1)


def test_measures_reject_unknown_names(wh):
    with pytest.raises(KeyError, match="nope"):
        measures.evaluate(wh, ["nope"])


def test_every_measure_evaluates_in_every_context(wh):
    assert len(measures.names()) == 31
    untimed = [m for m in measures.names() if m not in measures.TIME]
    for by in ([], ["credit_band"], ["card_type", "spend_category"]):
        df = measures.evaluate(wh, untimed, by=by)
        assert df.columns == [*by, *untimed] and df.count() > 0
        with pytest.raises(ValueError, match="time measures need one of"):
            measures.evaluate(wh, measures.names(), by=by)
    for by in (["year", "channel_name"], ["credit_band", "month_start"], ["full_date"]):
        df = measures.evaluate(wh, measures.names(), by=by)
        assert df.columns == [*by, *measures.names()] and df.count() > 0


def test_time_measures_see_quiet_days_of_every_group(wh):
    by_day = measures.evaluate(wh, ["total_spend", "spend_mtd"], by=["channel_name", "full_date"]).collect()
    days = {r.full_date for r in by_day}
    assert len(by_day) == len(days) * len({r.channel_name for r in by_day})
    whole = measures.daily_spend(wh).collect()
    for r in whole:
        assert sum(x.spend_mtd for x in by_day if x.full_date == r.full_date) == r.spend_mtd


@pytest.mark.parametrize(("grain", "periods"), [("month_start", 1), ("year", 1), ("full_date", 5)])
def test_time_windows_run_over_days_with_facts_and_period_ends(spark, wh, grain, periods):
    daily = measures.evaluate(wh, measures._DAILY, ["channel_name", "full_date"])
    groups = daily.select("channel_name").distinct().count()
    rows = measures._days_and_ends(wh, daily, ["channel_name"], grain)
    assert rows.count() <= daily.count() + groups * periods


def test_sparse_time_windows_equal_those_over_every_day(spark):
    """Groups with gaps of months: each period's values are those of its last day in the dense calendar."""
    days = ["2017-01-03", "2017-01-31", "2017-02-28", "2017-05-01", "2018-01-02", "2018-01-03", "2018-02-28"]
    made = [(str(100 + i), f"{d} 10:00:00", "1", "10", f"${i + 1}.00", ["Chip Transaction", "Online Transaction"][i % 3 == 1], "1", "Austin", "TX", None, "5812", None) for i, d in enumerate(days)]
    gaps = warehouse(spark, transactions=made, labels=LABELS)
    names = ["spend_mtd", "spend_ytd", "spend_running_total", "spend_rolling_30d"]
    dense = {(r.channel_name, r.full_date): r for r in measures.evaluate(gaps, names, by=["channel_name", "full_date"]).collect()}
    last = max(d for _, d in dense)
    for grain in ("month_start", "year"):
        got = measures.evaluate(gaps, [*names, "spend_py"], by=["channel_name", grain]).collect()
        per = {(r.channel_name, r[grain]): r for r in got}
        ends = {}
        for channel, day in dense:
            start = day.replace(day=1) if grain == "month_start" else day.year
            ends[channel, start] = max(ends.get((channel, start), day), day)
        assert set(per) == set(ends) and max(ends.values()) == last
        for key, day in ends.items():
            assert [per[key][n] for n in names] == [dense[key[0], day][n] for n in names]


def test_filters_meet_the_dimension_before_the_fact(wh):
    both = measures.evaluate(wh, ["transactions"], by=["card_type"]).collect()
    for r in both:
        one = measures.evaluate(wh, ["transactions"], filters={"card_type": [r.card_type]}).first()
        assert one.transactions == r.transactions


def test_spend_per_day_uses_calendar_days(wh):
    row = measures.evaluate(wh, ["total_spend", "spend_per_day"]).first()
    assert row.spend_per_day == pytest.approx(float(row.total_spend) / 5)


def test_staging_gate_passes_then_catches_each_fault(spark, wh):
    with pytest.raises(GateFailed) as none:  # the quoted empty error text is no fault
        enforce("x", cw.staging_gate(wh).withColumn("forced", F.lit(1)))
    assert set(none.value.counters) == {"forced"}
    bad = TRANSACTIONS + [
        ("7", None, "99", "98", None, "Chip Transaction", "1", "Austin", "TX", None, None, None),
        ("8", "2017-01-05 03:00:00", "1", "10", "$1.00", "Chip Transaction", "1", "Austin", "TX", None, "1234", None),
    ]
    row = cw.staging_gate(warehouse(spark, transactions=bad)).first()
    assert {k: int(v) for k, v in row.asDict().items()} == {
        "null_dates": 1, "null_amounts": 1, "null_mcc": 1, "failed_without_error": 0, "orphan_cards": 1,
        "orphan_clients": 1, "unknown_mcc": 2,
    }


def test_reconciliation_catches_each_fault(spark, wh):
    clean = cw.reconciliation_gate(wh).first().asDict()
    assert {k for k, v in clean.items() if v} == {"empty_bi_days"} and clean["empty_bi_days"] == 1  # 3 January
    bad = TRANSACTIONS + [
        ("7", "2017-01-03 01:00:00", "1", "10", None, "Kiosk Transaction", "1", None, "TX", None, "5812", "Bad Mood"),
    ]
    row = cw.reconciliation_gate(warehouse(spark, transactions=bad)).first().asDict()
    assert {k: int(v) for k, v in row.items() if v} == {
        "unmatched_channel": 1, "unmatched_location": 1, "unbanded_ticket": 1, "unknown_errors": 1, "wrong_location": 1,
    }
    twice = warehouse(spark, labels=LABELS + [("1", "Yes")])
    row = cw.reconciliation_gate(twice).first().asDict()
    assert int(row["rows_lost"]) == -1 and row["amount_drift"] == 77


def test_channel_disagreement_is_only_counted(wh):
    assert cw.channel_disagreement(wh).first()[0] == 1


def test_publish_and_read_back(spark, wh, tmp_path):
    root = str(tmp_path / "dw")
    counts = wh.publish(root)
    assert counts["fact_transaction"] == 6 and counts["br_transaction_error"] == 5 and counts["dim_date"] == 3652
    stored = cw.PublishedCardWarehouse(spark, root)
    for build in ALL_REPORTS:
        assert rows_of(build(stored)) == rows_of(build(wh)), build.__name__
    assert rows_of(stored.bridge) == rows_of(wh.bridge)
    assert "PartitionFilters: [isnotnull(fact_year" in stored.window_fact._jdf.queryExecution().toString()


def test_views_are_queryable(spark, wh):
    wh.register_views()
    assert spark.sql("SELECT count(*) FROM bi_fact_transaction JOIN bi_dim_date USING (date_key)").first()[0] == 5
