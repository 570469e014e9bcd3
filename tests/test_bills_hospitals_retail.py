from __future__ import annotations

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from stellate.operators.gates import GateFailed, enforce
from stellate.plans import bill_payments as bills
from stellate.plans import retail_sales as retail
from stellate.plans import trauma_access as trauma
from stellate.sources import schemas
from tests.conftest import rows_of

BILLS = [
    ("T1", "2026-01-04", 1, "Ani ", "Listrik", "PLN ", 9, 1000, 100, 1100, "ATM", "Sukses"),
    ("T2", "2026-01-05", 1, "Ani", "Listrik", "PLN", 9, None, 100, 100, "EDC", " Gagal"),
    ("T3", "2026-01-05", 2, "Budi", "Air", "PDAM", 8, 500, None, 500, "ATM", "Pending"),
    ("T4", "2026-04-01", 2, "Budi", "Air", "PDAM", 8, 500, 50, 550, "ATM ", "Sukses "),
]


def bill_warehouse(spark, rows=BILLS):
    return bills.BillWarehouse.from_raw(spark.createDataFrame(rows, schemas.BILLS))


def test_bill_staging(spark):
    staged = {r.id_transaksi: r for r in bill_warehouse(spark).staged.collect()}
    assert (staged["T2"].nominal, staged["T3"].biaya_admin) == (0, 0)
    assert [staged[f"T{i}"].is_success for i in range(1, 5)] == [1, 0, 0, 1]
    assert (staged["T2"].status, staged["T1"].nama_biller, staged["T4"].channel) == ("Gagal", "PLN", "ATM")


def test_bill_gate(spark):
    assert enforce("bills", bills.staging_gate(bill_warehouse(spark).staged))
    bad = BILLS + [("T5", None, 2, "x", "Air", "PDAM", 8, 1, 1, 3, " ", None)]
    with pytest.raises(GateFailed) as failure:
        enforce("bills", bills.staging_gate(bill_warehouse(spark, bad).staged))
    assert failure.value.counters == {"null_dates": 1, "null_channels": 1, "null_status": 1, "amount_mismatch": 1}


def test_bill_star_equals_the_short_path(spark):
    wh = bill_warehouse(spark)
    assert rows_of(wh.dim_biller) == [(1, "Air", "PDAM"), (2, "Listrik", "PLN")]
    assert rows_of(wh.dim_channel) == [(1, "ATM"), (2, "EDC")]
    assert {(r.date_key, r.day_of_week) for r in wh.dim_date.collect()} == {(20260104, 0), (20260105, 1), (20260401, 3)}
    assert rows_of(wh.report) == rows_of(bills.report_from_staging(wh.staged))
    assert tuple(int(v) for v in wh.load_check().first()) == (4, 4, 4, 4)


def test_bill_gates_see_rows_the_report_would_lose(spark):
    nameless = [*BILLS, ("T5", "2026-04-02", 2, "Budi", "Air", None, 8, 500, 50, 550, "ATM", "Sukses")]
    wh = bill_warehouse(spark, nameless)
    assert tuple(int(v) for v in wh.load_check().first()) == (5, 5, 5, 4)
    assert rows_of(wh.reference_gate()) == [("biller_key", 1, 0), ("channel_key", 0, 0), ("date_key", 0, 0)]
    assert ("dim_biller", 0, 1) in rows_of(wh.key_gate())


def test_bill_reports(spark):
    report = bills.report_from_staging(bill_warehouse(spark).staged)
    months = {r.month: r for r in bills.volume_per_month(report).collect()}
    assert months[4].data_note == "PARTIAL MONTH" and months[1].days_with_data == 2
    split = {r.status: r for r in bills.status_split(report).collect()}
    assert (split["Gagal"].fees_forgone, split["Sukses"].fees_forgone, split["Sukses"].share_pct) == (100, 0, 50.0)
    trend = bills.daily_trend(report, "2026-04-01").collect()
    assert [str(r.full_date) for r in trend] == ["2026-01-04", "2026-01-05"]
    assert report.agg(F.sum("net_revenue"), F.sum("gmv_settled")).first() == (150, 1650)


def test_bill_publish(spark, tmp_path):
    counts = bill_warehouse(spark).publish(str(tmp_path / "dw"))
    assert counts == {"fact_transactions": 4, "dim_date": 3, "dim_channel": 2, "dim_biller": 2}


def hospital(id, name, lat, lon, **other):
    row = dict.fromkeys(schemas.HOSPITALS.fieldNames())
    row.update(
        id=id, name=name, address="a", city="c", state="TX", type="GENERAL ACUTE CARE", status="OPEN", latitude=lat,
        longitude=lon, beds="10", trauma="NOT AVAILABLE", helipad="N", owner="NON-PROFIT", alt_name="NOT AVAILABLE",
        website="w", sourcedate="2020/02/29 00:00:00+00",
    )
    row.update(other)
    return tuple(row[c] for c in schemas.HOSPITALS.fieldNames())


HOSPITALS = [
    hospital("1", "A", "30", "-97", trauma="LEVEL I", owner="GOVERNMENT - FEDERAL", helipad="Y"),
    hospital("2", "B", "30", "-96", trauma="RTC", state="LA", beds="-999", helipad="x"),
    hospital("3", "C", "30", "-96.5", owner="NOT AVAILABLE", trauma="NEW ONE"),
    hospital("4", "D", "30.1", "-97", type="CRITICAL ACCESS"),
    hospital("5", "E", "18", "-66", state="PR", trauma="LEVEL II"),
    hospital("6", "F", "30", "-97.01", status="CLOSED", trauma="LEVEL II"),
    hospital("7", "D", "34.5", "-97", city=None),
    hospital("8", "D", "34.6", "-97", city=None, trauma="LEVEL III"),
    hospital("9", "G", None, "-97"),
]


@pytest.fixture(scope="module")
def staged(spark):
    return trauma.stage_hospitals(spark.createDataFrame(HOSPITALS, schemas.HOSPITALS))


@pytest.fixture(scope="module")
def access(staged):
    return trauma.hospital_access(staged)


def test_hospital_staging(staged):
    h = {r.hospital_id: r for r in staged.collect()}
    assert (h["1"].owner_group, h["3"].owner_group, h["3"].owner_type, h["2"].owner_group) == (
        "GOVERNMENT", None, None, "NON-PROFIT")
    assert (h["2"].beds, h["1"].has_helipad, h["4"].has_helipad, h["2"].has_helipad) == (None, True, False, None)
    assert [h[i].units_at_site for i in ("7", "8", "4", "1")] == [2, 2, 1, 1]
    assert (h["2"].trauma_adult_level, h["3"].trauma_category, h["1"].trauma_category) == (2, None, "ADULT")
    assert h["5"].is_us_state is False and h["1"].source_date == datetime.date(2020, 2, 29)


def test_access(access):
    h = {r.hospital_id: r for r in access.collect()}
    assert set(h) == {"1", "2", "3", "4", "7", "8", "9"}
    assert (h["1"].distance_km, h["1"].nearest_trauma_id, h["1"].is_level12_trauma) == (0, "1", True)
    assert (h["3"].nearest_trauma_id, h["3"].distance_band) == ("1", "25-50 km")  # both centres equally far
    assert h["4"].distance_band == "< 25 km" and h["7"].distance_band == "> 200 km"
    assert h["8"].is_level12_trauma is False
    assert (h["9"].distance_km, h["9"].distance_band, h["9"].nearest_trauma_id) == (None, "> 200 km", None)


def test_state_summary(access):
    s = {r.state: r for r in trauma.state_summary(access).collect()}
    tx = s["TX"]
    assert (tx.n_hospitals, tx.n_sites, tx.n_level12_trauma, tx.n_critical_access) == (6, 5, 1, 1)
    assert tx.total_beds == 60 and s["LA"].total_beds is None and s["LA"].pct_beds_reported == 0
    assert tx.pct_critical_access == 0.1667 and tx.n_over_100km == 2
    assert (tx.trauma_reporting_rate, tx.trauma_reporting_flag) == (0.3333, "OK")
    total = trauma.summary_check(trauma.state_summary(access)).first()
    assert tuple(total) == (7, 2)


def test_low_reporting_flag(spark):
    rows = [hospital(str(i), f"N{i}", "30", "-97") for i in range(11)] + [hospital("c", "X", "30", "-96", trauma="LEVEL I")]
    found = trauma.state_summary(trauma.hospital_access(trauma.stage_hospitals(spark.createDataFrame(rows, schemas.HOSPITALS))))
    assert found.first().trauma_reporting_flag == "LOW"


def test_hospital_gates(spark, staged, access):
    raw = spark.createDataFrame(HOSPITALS, schemas.HOSPITALS)
    assert rows_of(trauma.unmapped_designations(raw)) == [("NEW ONE",)]
    assert trauma.null_profile(staged).first().asDict() == {
        "beds_null": 1, "owner_null": 1, "helipad_null": 1, "website_null": 0, "source_date_null": 0}
    with pytest.raises(GateFailed) as failure:
        enforce("distance", trauma.distance_gate(access))
    assert failure.value.counters == {"distance_null": 1}
    counts = trauma.row_check(staged, access).first()
    assert tuple(int(v) for v in counts) == (9, 7, 7)


def test_trauma_map_has_unique_keys(spark):
    assert trauma.trauma_map(spark).groupBy("trauma_raw").count().filter("count > 1").count() == 0
    assert trauma.trauma_map(spark).count() == 31


SALES = [
    (1, "2023-01-07", 8, "North", 10, "20.00"), (2, "2023-01-09", 11, "South", 2, "30.00"),
    (1, "2023-02-06", 10, "North", 5, "10.00"), (2, "2023-02-06", 15, "South", 1, "65.00"),
]


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(p, datetime.date.fromisoformat(d), h, s, q, decimal.Decimal(v)) for p, d, h, s, q, v in SALES]
    return spark.createDataFrame(
        rows, "product_id long, sale_date date, sale_hour int, store string, quantity long, revenue decimal(12,2)"
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Chai", "Tea"), (2, "Espresso", "Coffee")], "product_id long, product string, category string")


def test_retail(sales, items):
    months = retail.monthly_growth(sales).collect()
    assert [(m.mom_pct, m.growth_first_to_last_pct) for m in months] == [(None, 50.0), (50.0, 50.0)]
    stores = {r.store: r for r in retail.stores(sales).collect()}
    assert stores["North"].revenue_per_day == 15.0
    assert stores["South"].spread_pct == pytest.approx(100 * (95 - 30) / 30)
    kinds = {r.day_kind: (r.days, r.revenue_per_day) for r in retail.weekday_weekend(sales).collect()}
    assert kinds == {"Weekday": (2, 52.5), "Weekend": (1, 20.0)}
    parts = {r.day_part: r.share_pct for r in retail.day_part_shares(sales).collect()}
    assert parts == {"Morning Rush": 24.0, "Midday": 24.0, "Afternoon": 52.0}


def test_best_seller_is_not_top_by_revenue(sales, items):
    first = retail.leaders_compared(sales, items, k=1).first()
    assert (first.product, first.quantity_rank, first.revenue_rank) == ("Chai", 1, 2)
    assert retail.top_products(sales, items, "revenue", 1).first().product == "Espresso"
    assert {r.category: r.share_pct for r in retail.category_shares(sales, items).collect()} == {"Tea": 24.0, "Coffee": 76.0}
