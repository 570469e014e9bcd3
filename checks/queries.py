"""Every registered query: a report or operator of the library over the driver tables.

Outputs use types that both engines print alike: dates as text, money as
decimal(18,2), rates as double, counts as bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import DateType, DecimalType, IntegralType, TimestampNTZType

from stellate.functions import bands, calendar, text
from stellate.functions.geo import haversine_km
from stellate.functions.literals import literal_table
from stellate.functions.rates import percent, ratio, rows, rows_where, sum_where
from stellate.operators import gates, intervals, joins, numbering, order_statistics, periods
from stellate.operators.nearest import nearest_target
from stellate.operators.shares import with_share
from stellate.operators.star import split_by_dimensions
from stellate.plans import bill_payments as bills
from stellate.plans import card_measures as measures
from stellate.plans import card_reports as card
from stellate.plans import card_warehouse as cw
from stellate.plans import retail_sales as retail
from stellate.plans import trauma_access as trauma
from stellate.session import cut_lineage, scratch_path
from stellate.sources import driver_tables as driver
from stellate.sources import publish, readers, schemas

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Output types for comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DateType, TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, DecimalType):
            c = c.cast("decimal(18,2)")
        elif isinstance(f.dataType, IntegralType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _plain(build(spark, sf_dir))
        return build

    return register


def _card(spark: SparkSession, sf_dir: str) -> cw.CardWarehouse:
    return cw.CardWarehouse(spark, lambda name: driver.card_source(spark, sf_dir, name))


def _bills(spark: SparkSession, sf_dir: str) -> bills.BillWarehouse:
    return bills.BillWarehouse.from_raw(driver.bill_payments(spark, sf_dir))


def _bill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.report_from_staging(_bills(spark, sf_dir).staged)


def _hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trauma.stage_hospitals(driver.hospitals(spark, sf_dir))


def _over(build: Callable, source: Callable) -> Query:
    return lambda spark, sf_dir: build(source(spark, sf_dir))


# -- card reports -------------------------------------------------------------

for _name, _build in {
    "f3_1_1_leakage_by_year": card.leakage_by_year,
    "f3_1_2_failures_by_error": card.failures_by_error,
    "f3_1_3_failure_by_channel": card.failure_by_channel,
    "f3_1_4_expired_card_declines": card.expired_card_declines,
    "f3_1_5_failure_by_category": card.failure_by_category,
    "f3_1_6_error_mix_by_category": card.error_mix_by_category,
    "f3_1_7_stale_declines_rollup": card.stale_declines_by_category,
    "f3_1_7b_stale_rate_by_segment": card.stale_rate_by_segment,
    "f3_1_7c_stale_by_category": card.stale_by_category,
    "f3_2_1_label_coverage": card.label_coverage,
    "f3_2_2_fraud_by_channel": card.fraud_by_channel,
    "f3_2_3_fraud_by_category": card.fraud_by_category,
    "f3_2_4_fraud_by_ticket_band": card.fraud_by_ticket_band,
    "f3_2_5_loss_concentration": card.loss_concentration,
    "f3_2_6_worst_hours": card.worst_hours,
    "f3_2_7_evening_block": card.evening_block,
    "f3_2_8_fraud_by_card_type": card.fraud_by_card_type,
    "f3_2_9_ticket_size_signal": card.ticket_size_signal,
    "f3_3_1_leakage_by_credit_band": card.leakage_by_credit_band,
    "f3_3_2_declines_by_debt_band": card.declines_by_debt_band,
    "f3_3_3_utilisation_by_limit_band": card.utilisation_by_limit_band,
    "f3_3_4_by_brand_type_chip": card.by_brand_type_chip,
    "f3_4_1_channel_mix_by_year": card.channel_mix_by_year,
    "f3_4_2_fraud_by_era_and_channel": card.fraud_by_era_and_channel,
    "f3_4_3_online_share_of_loss": card.online_share_of_loss,
    "f3_4_4_label_regime_by_year": card.label_regime_by_year,
    "n_1_fault_owner_totals": card.failures_by_fault_owner,
    "n_2_issuer_value_per_year": card.issuer_value_per_year,
    "n_3_stale_per_month": card.stale_per_month,
    "n_4_evening_shares": card.evening_shares,
    "n_5_segment_ratios": card.segment_ratios,
}.items():
    query(_name)(_over(_build, _card))


@query("n_7_cards_hit_by_expiry_per_year")
def _n7(spark, sf_dir):
    return card.expired_card_declines(_card(spark, sf_dir)).select("year", "cards_affected")


@query("n_8_error_mix_side_by_side")
def _n8(spark, sf_dir):
    return card.error_mix_side_by_side(_card(spark, sf_dir), ("Restaurants & Bars", "Utilities & Telecom"))


# -- card staging, dimensions, fact -------------------------------------------


def _staged_columns(staged: DataFrame) -> DataFrame:
    return staged.withColumn("error_list", F.array_join("error_list", "|"))


@query("p1_stage_transactions")
def _p1(spark, sf_dir):
    return _staged_columns(_card(spark, sf_dir).transactions)


@query("p2_stage_clients")
def _p2(spark, sf_dir):
    staged = _card(spark, sf_dir).clients
    return staged.withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude", "debt_to_income")})


@query("p3_stage_cards")
def _p3(spark, sf_dir):
    return _card(spark, sf_dir).cards


@query("p8_client_bands")
def _p8(spark, sf_dir):
    return _card(spark, sf_dir).dim_client.select(
        "client_id", "age_band", "age_band_order", "credit_band", "credit_band_order",
        "income_band", "income_band_order", "dti_band", "dti_band_order",
    )


@query("p8_card_limit_bands")
def _p8b(spark, sf_dir):
    return _card(spark, sf_dir).dim_card.select("card_id", "credit_limit", "limit_band", "limit_band_order")


@query("p10_spend_category")
def _p10(spark, sf_dir):
    """Part keys spread over all four-digit codes, listed ones, the 3000 range and the rest."""
    parts = driver.table(spark, sf_dir, "part").select((F.col("p_partkey") * 7919 % 10000).cast("int").alias("mcc"))
    return (
        parts.withColumn("spend_category", cw.spend_category(F.col("mcc")))
        .groupBy("spend_category")
        .agg(rows().alias("n"), F.min("mcc").alias("lowest"), F.max("mcc").alias("highest"))
    )


@query("p10_every_code")
def _p10_every_code(spark, sf_dir):
    """Every four-digit code with its category, and the parts dealt to it."""
    parts = driver.table(spark, sf_dir, "part").groupBy((F.col("p_partkey") * 7919 % 10000).cast("int").alias("mcc")).agg(rows().alias("parts"))
    codes = spark.range(10_000).select(F.col("id").cast("int").alias("mcc"))
    return codes.join(parts, "mcc", "left").select(
        "mcc", cw.spend_category(F.col("mcc")).alias("spend_category"), F.coalesce("parts", F.lit(0)).alias("parts")
    )


@query("p14_channel_disagreement")
def _p14(spark, sf_dir):
    return cw.channel_disagreement(_card(spark, sf_dir))


@query("p20_window_fact_by_month")
def _p20(spark, sf_dir):
    wh = _card(spark, sf_dir)
    month = F.floor(F.col("date_key") / 100).cast("int")
    return wh.window_charges.groupBy(month.alias("month_key")).agg(
        rows().alias("transactions"), F.sum("amount").alias("amount")
    )


def _calendar_years(days: DataFrame) -> DataFrame:
    return days.groupBy("year").agg(
        rows().alias("days"), F.min("full_date").alias("first_day"), F.max("full_date").alias("last_day")
    )


@query("p21_window_calendar")
def _p21(spark, sf_dir):
    return _calendar_years(_card(spark, sf_dir).window_calendar)


@query("k1_generated_calendar")
def _k1(spark, sf_dir):
    """The generated calendar with the transactions of each of its days, quiet days included."""
    wh = _card(spark, sf_dir)
    per_day = wh.charges.groupBy("date_key").agg(rows().alias("transactions"))
    return wh.dim_date.join(per_day, "date_key", "left").na.fill(0, ["transactions"])


@query("k6_location_dimension")
def _k6(spark, sf_dir):
    return _card(spark, sf_dir).dim_location.drop("location_key")


@query("k5_location_key_on_fact")
def _k5(spark, sf_dir):
    """Facts per place, reached through the key."""
    wh = _card(spark, sf_dir)
    per_key = wh.charges.groupBy("location_key").agg(rows().alias("transactions"), F.sum("amount").alias("amount"))
    return per_key.join(wh.dim_location, "location_key").select("city", "state", "zip", "transactions", "amount")


@query("k7_fixed_dimensions_in_use")
def _k7(spark, sf_dir):
    """The three literal dimensions, each with the declined facts that use its rows."""
    wh = _card(spark, sf_dir)
    used = cw.bridge_of(wh.charges, "channel_key", "ticket_band_key")
    used = used.groupBy("channel_key", "ticket_band_key", "error_key").agg(rows().alias("declines"))
    return (
        used.join(wh.dim_channel, "channel_key")
        .join(wh.dim_ticket_band, "ticket_band_key")
        .join(wh.dim_error, "error_key")
        .select(
            "channel_name", "is_card_present", "ticket_band", "lower_bound", "upper_bound", "error_name",
            "fault_owner", "declines",
        )
    )


@query("k11_fact")
def _k11(spark, sf_dir):
    return _card(spark, sf_dir).fact.drop("location_key", "error_keys")


@query("k12_error_bridge")
def _k12(spark, sf_dir):
    return _card(spark, sf_dir).bridge


@query("k15_window_bridge_by_error")
def _k15(spark, sf_dir):
    wh = _card(spark, sf_dir)
    wh.register_views()
    return spark.sql(
        "SELECT e.error_name, e.fault_owner, count(*) AS declines, count(DISTINCT b.transaction_id) AS transactions "
        "FROM bi_br_transaction_error b JOIN bi_dim_error e USING (error_key) GROUP BY e.error_name, e.fault_owner"
    )


@query("j5_ticket_band_by_range")
def _j5(spark, sf_dir):
    """The range lookup as a projection; every row keeps its place even without a band."""
    events = driver.table(spark, sf_dir, "events").select((F.col("value") * 2).cast("decimal(12,2)").alias("v"))
    return events.groupBy(bands.TICKET.key(F.col("v")).alias("ticket_band_key")).agg(
        rows().alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest")
    )


@query("j5_order_bands_from_a_table")
def _j5_table(spark, sf_dir):
    """Orders against bands that come as rows: one band per nation's mean price, the last one open, none below the first."""
    orders = driver.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    cuts = driver.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 20000 + 1500).cast("decimal(18,2)").alias("lower_bound"))
    ahead = Window.orderBy("lower_bound")
    bands_ = cuts.select("lower_bound", F.lead("lower_bound").over(ahead).alias("upper_bound"), F.row_number().over(ahead).alias("band"))
    banded = intervals.with_band(orders, "price", bands_, "lower_bound", "upper_bound", ["band"])
    return banded.groupBy("band").agg(rows().alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"))


@query("j5_promotions_by_cells")
def _j5_cells(spark, sf_dir):
    """The same without the index for few intervals."""
    return _j5_overlapping(spark, sf_dir, 0)


@query("j5_promotions_that_overlap")
def _j5_overlapping(spark, sf_dir, index_rows=intervals.INDEX_ROWS):
    """Lines against price ranges of suppliers, which overlap and of which some have no upper end."""
    lines = driver.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    key = F.col("s_suppkey")
    low = (key * 7919 % 90000).cast("decimal(18,2)")
    ranges = driver.table(spark, sf_dir, "supplier").select(
        key.alias("promotion"), low.alias("lower_bound"), F.when(key % 20 != 7, low + 400 + key % 300).cast("decimal(18,2)").alias("upper_bound")
    )
    totals = {"n": F.lit(1), "price": F.col("price")}
    met = intervals.interval_join(lines, "price", ranges, "lower_bound", "upper_bound", index_rows, totals)
    return met.groupBy("promotion").agg(F.sum("n").alias("n"), F.sum("price").alias("price"))


@query("j7_value_per_error_and_per_transaction")
def _j7(spark, sf_dir):
    """The fan-out through the bridge next to the count that takes each transaction once."""
    wh = _card(spark, sf_dir)
    per_error = cw.bridge_of(wh.window_charges, "abs_amount").agg(
        rows().alias("declines"), F.sum("abs_amount").alias("value_per_error")
    )
    once = wh.window_charges.filter("is_failed").agg(
        rows().alias("transactions"), F.sum("abs_amount").alias("value_per_transaction")
    )
    return gates.side_by_side(per_error, once).select(
        F.col("declines").cast("long").alias("declines"), "value_per_error",
        F.col("transactions").cast("long").alias("transactions"), "value_per_transaction",
    )


@query("j9_semi_join_as_flag")
def _j9(spark, sf_dir):
    """Orders that hold a returned line, as a flag on the order."""
    orders = driver.table(spark, sf_dir, "orders")
    returned = driver.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    flagged = joins.flag_members(orders.select("o_orderkey", "o_orderpriority"), returned, "o_orderkey", "has_return")
    return flagged.groupBy("o_orderpriority").agg(
        rows().alias("orders"), rows_where(F.col("has_return")).alias("with_return"),
    )


@query("j11_customers_without_orders")
def _j11(spark, sf_dir):
    customers = driver.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    """Customers without an order in the tables' first year."""
    early = driver.table(spark, sf_dir, "orders").filter("o_orderdate < '1996-01-01'")
    orders = early.select(F.col("o_custkey").alias("c_custkey"))
    idle = joins.missing_keys(customers, orders.distinct(), "c_custkey")
    return customers.join(idle, "c_custkey").groupBy("c_mktsegment").agg(rows().alias("idle"))


@query("j13_nearest_supplier")
def _j13(spark, sf_dir):
    def placed(name, key, a, b):
        n = F.col(key)
        return driver.table(spark, sf_dir, name).select(
            n, ((2500 + (n * a) % 2400) / F.lit(100)).alias("latitude"), ((-12400 + (n * b) % 5700) / F.lit(100)).alias("longitude")
        )

    found = nearest_target(placed("customer", "c_custkey", 37, 91), placed("supplier", "s_suppkey", 53, 71), "c_custkey", "s_suppkey")
    return found.select("c_custkey", "s_suppkey", F.round("distance_km", 1).alias("distance_km"))


# -- card gates ---------------------------------------------------------------


def _whole(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) for c in df.columns])


def _faulty_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The card sources with a fault for every counter of the gates."""
    raw = driver.card_source(spark, sf_dir, name)
    n = F.expr("CAST(id AS BIGINT)") if name in ("transactions", "users", "cards") else None
    if name == "transactions":
        changed = {
            "date": F.when(n % 89 == 11, "2020-01-05 10:00:00").when(n % 101 != 7, F.col("date")),
            "amount": F.when(n % 103 != 5, F.col("amount")),
            "mcc": F.when(n % 107 == 3, "1234").when(n % 109 != 4, F.col("mcc")),
            "card_id": F.when(n % 113 == 6, "-1").otherwise(F.col("card_id")),
            "client_id": F.when(n % 127 == 9, "-1").otherwise(F.col("client_id")),
            "use_chip": F.when(n % 131 == 8, "Mail Order").otherwise(F.col("use_chip")),
            "merchant_city": F.when(n % 137 != 2, F.col("merchant_city")),
            "errors": F.when(n % 139 == 12, "").when(n % 149 == 13, "Bad Mood").otherwise(F.col("errors")),
        }
        return raw.withColumns(changed)
    if name in ("users", "cards"):  # some rows twice
        return raw.unionByName(raw.filter(n % 151 == 1))
    return raw


def _with_faults(wh: cw.CardWarehouse) -> cw.CardWarehouse:
    """Facts of which some are lost and some have another amount, and codes of which some have no category."""

    def worn(fact: DataFrame) -> DataFrame:
        n = F.col("transaction_id")
        drifted = F.when(n % 163 == 4, F.col("amount") + 1).otherwise(F.col("amount"))
        return fact.filter(n % 157 != 3).withColumn("amount", drifted.cast("decimal(12,2)"))

    wh.fact, wh.charges = worn(wh.fact), worn(wh.charges)
    wh.dim_mcc = wh.dim_mcc.withColumn("spend_category", F.when(F.col("mcc") % 5 != 0, F.col("spend_category")))
    return wh


def _faulty_card(spark: SparkSession, sf_dir: str) -> cw.CardWarehouse:
    return _with_faults(cw.CardWarehouse(spark, lambda name: _faulty_source(spark, sf_dir, name)))


def _faulty_staged(spark: SparkSession, sf_dir: str) -> cw.CardWarehouse:
    """The same, staged and published."""
    root = scratch_path(spark, "faulty")
    cw.CardWarehouse(spark, lambda name: _faulty_source(spark, sf_dir, name)).publish_staging(root)
    return cw.StagedCardWarehouse(spark, publish.open_published(spark, root))


def _published(spark: SparkSession, staged: cw.CardWarehouse) -> cw.PublishedCardWarehouse:
    root = scratch_path(spark, "published")
    staged.publish(root)
    return cw.PublishedCardWarehouse(spark, publish.open_published(spark, root), staged=staged)


def _faulty_bills(spark: SparkSession, sf_dir: str) -> bills.BillWarehouse:
    """Bills of which some have no biller and some no channel."""
    raw = driver.bill_payments(spark, sf_dir)
    n = F.expr("CAST(substr(id_transaksi, 3) AS BIGINT)")
    return bills.BillWarehouse.from_raw(raw.withColumns({
        "nama_biller": F.when(n % 13 != 5, F.col("nama_biller")),
        "channel": F.when(n % 17 != 6, F.col("channel")),
    }))


@query("q1_card_staging_gate")
def _q1(spark, sf_dir):
    return _whole(cw.staging_gate(_faulty_card(spark, sf_dir)))


@query("q5_card_reconciliation")
def _q5(spark, sf_dir):
    return _whole(cw.reconciliation_gate(_faulty_card(spark, sf_dir)))


@query("q6_card_sizes")
def _q6(spark, sf_dir):
    return _whole(cw.sizes(_card(spark, sf_dir)))


@query("q1_card_staging_gate_from_the_write")
def _q1_written(spark, sf_dir):
    """Row counters from the manifest, orphans from one scan of the written table."""
    return _whole(cw.staging_gate(_faulty_staged(spark, sf_dir)))


@query("q5_card_reconciliation_from_the_write")
def _q5_written(spark, sf_dir):
    return _whole(cw.reconciliation_gate(_published(spark, _with_faults(_faulty_staged(spark, sf_dir)))))


@query("q6_card_sizes_from_the_write")
def _q6_written(spark, sf_dir):
    return _whole(cw.sizes(_published(spark, _card(spark, sf_dir))))


@query("q12_card_keys")
def _q12(spark, sf_dir):
    """With bridge rows that come twice and places that share a key."""
    wh = cw.CardWarehouse(spark, lambda name: _faulty_source(spark, sf_dir, name))
    wh.bridge = wh.bridge.unionByName(wh.bridge.filter(F.col("transaction_id") % 167 == 5))
    place = wh.dim_location
    wh.dim_location = place.unionByName(place.filter(F.col("zip") % 7 == 1).withColumn("zip", F.col("zip") + 1))
    return cw.key_gate(wh)


@query("q12_ids_where_they_lie")
def _q12_ids(spark, sf_dir):
    """Staged ids, some of which come twice, grouped in their buckets."""
    raw = lambda name: driver.card_source(spark, sf_dir, name)
    def twice(name):
        if name not in ("transactions", "fraud_labels"):
            return raw(name)
        n = F.col("id" if name == "transactions" else "transaction_id").cast("long")
        return raw(name).unionByName(raw(name).filter(n % (173 if name == "transactions" else 179) == 6))
    root = scratch_path(spark, "ids")
    wh = cw.CardWarehouse(spark, twice)
    wh.publish_staging(root)
    return cw.id_gate(cw.StagedCardWarehouse(spark, publish.open_published(spark, root)))


@query("j1_co_located_labels")
def _j1(spark, sf_dir):
    """Staged transactions and labels joined where they lie: both are dealt by id into the same buckets."""
    root = scratch_path(spark, "co_located")
    wh = _card(spark, sf_dir)
    ids = {"bucket_by": "transaction_id", "buckets": publish.FEWEST_BUCKETS}
    publish.publish_layer(spark, root, {
        "typed": publish.Landing(wh.typed, **ids), "labels": publish.Landing(cw.type_labels(wh.labels), **ids),
    })
    read = publish.open_published(spark, root)
    return _staged_columns(cw.attach_labels(read("typed"), read("labels")))


@query("p21_window_calendar_from_the_manifest")
def _p21_written(spark, sf_dir):
    return _calendar_years(_published(spark, _card(spark, sf_dir)).window_calendar)


@query("p20_month_of_a_clustered_fact")
def _p20_clustered(spark, sf_dir):
    """Months of one year, read from files that hold ranges of days."""
    fact = _published(spark, _card(spark, sf_dir)).fact
    year = fact.filter((F.col(cw.YEAR_FOLDER) == 2018) & F.col("date_key").between(20180301, 20180531))
    return year.groupBy("date_key").agg(rows().alias("n"), F.sum("amount").alias("amount"))


# -- measures -----------------------------------------------------------------


@query("m1_m17_core_by_year")
def _m1(spark, sf_dir):
    names = [
        "transactions", "total_spend", "gross_spend", "refund_value", "avg_ticket", "failed_transactions",
        "failure_rate", "approval_rate", "failed_value", "issuer_owned_failed_value", "labelled_transactions",
        "label_coverage", "fraud_transactions", "fraud_rate", "fraud_loss", "avg_fraud_ticket", "fraud_loss_bps",
    ]
    return measures.evaluate(_card(spark, sf_dir), names, by=["year"])


@query("m1_m17_core_by_category_and_channel")
def _m1b(spark, sf_dir):
    names = ["transactions", "gross_spend", "failure_rate", "fraud_rate", "issuer_owned_failed_value"]
    return measures.evaluate(_card(spark, sf_dir), names, by=["spend_category", "channel_name"])


@query("m10_issuer_value_by_card_type")
def _m10(spark, sf_dir):
    return measures.evaluate(_card(spark, sf_dir), ["failed_value", "issuer_owned_failed_value"], by=["card_type"])


@query("m18_spend_per_day_by_month")
def _m18(spark, sf_dir):
    return measures.evaluate(_card(spark, sf_dir), ["total_spend", "spend_per_day"], by=["year", "month"])


@query("m18_spend_per_day_overall")
def _m18b(spark, sf_dir):
    return measures.evaluate(_card(spark, sf_dir), ["total_spend", "spend_per_day"])


@query("m19_m27_daily_spend")
def _m19(spark, sf_dir):
    return measures.daily_spend(_card(spark, sf_dir))


for _grain in ("year", "month", "day"):
    query(f"m21_m24_prior_year_by_{_grain}")(
        lambda spark, sf_dir, grain=_grain: measures.against_prior_year(_card(spark, sf_dir), grain)
    )


@query("m28_m31_stale_by_credit_band")
def _m28(spark, sf_dir):
    names = [
        "stale_credential_transactions", "stale_credential_value", "stale_credential_rate",
        "cards_with_stale_credential",
    ]
    return measures.evaluate(_card(spark, sf_dir), names, by=["credit_band"])


@query("m28_m31_stale_overall")
def _m28b(spark, sf_dir):
    names = [
        "stale_credential_transactions", "stale_credential_value", "stale_credential_rate",
        "cards_with_stale_credential",
    ]
    return measures.evaluate(_card(spark, sf_dir), names)


@query("m28_stale_cards_from_stored_sets")
def _m28_sets(spark, sf_dir):
    """Three groupings of distinct cards from one stored table of bitmaps."""
    sets = cut_lineage(measures.stale_card_sets(_card(spark, sf_dir), ["credit_band", "card_type", "year"]))
    found = None
    for by in (["credit_band"], ["card_type", "year"], []):
        label = F.concat_ws(" / ", *[F.col(c).cast("string") for c in by]) if by else F.lit("all")
        one = measures.cards_with_stale_credential(sets, by).select(
            F.lit(" / ".join(by)).alias("grouped_by"), label.alias("label"), F.col("cards_with_stale_credential").alias("cards")
        )
        found = one if found is None else found.unionByName(one)
    return found


@query("m_filtered_domestic_by_state")
def _mf(spark, sf_dir):
    return measures.evaluate(
        _card(spark, sf_dir), ["transactions", "refund_value", "avg_ticket"], by=["state", "is_domestic"],
        where=F.col("amount") != 0,
    )


@query("m19_m27_by_channel_and_month")
def _m19_by_channel(spark, sf_dir):
    return measures.evaluate(
        _card(spark, sf_dir), ["total_spend", *measures.TIME], by=["channel_name", "month_start"]
    )


@query("m21_m24_by_category_and_year")
def _m21_by_category(spark, sf_dir):
    names = ["spend_py", "spend_yoy", "failure_rate_py", "failure_rate_yoy_pp"]
    return measures.evaluate(_card(spark, sf_dir), names, by=["spend_category", "year"])


@query("m_filtered_by_card_type_and_category")
def _mf_dimension(spark, sf_dir):
    """Slicers on a dimension that grows and on a fixed one."""
    return measures.evaluate(
        _card(spark, sf_dir), ["transactions", "total_spend", "failure_rate"], by=["year"],
        filters={"card_type": ["Credit"], "spend_category": ["Restaurants & Bars", "Fuel & Automotive"]},
    )


# -- bill payments ------------------------------------------------------------

for _name, _build in {
    "b2_q1_volume_per_month": bills.volume_per_month,
    "b2_q2_revenue_per_month": bills.revenue_per_month,
    "b2_q3_top_billers": bills.top_billers,
    "b2_q4_channel_breakdown": bills.channel_breakdown,
    "b2_q5_status_split": bills.status_split,
    "b2_q6_success_by_dimension": bills.success_by_dimension,
}.items():
    query(_name)(_over(_build, _bill_report))


@query("b2_q7_daily_trend")
def _b2q7(spark, sf_dir):
    return bills.daily_trend(_bill_report(spark, sf_dir), "2001-08-01")


@query("p4_stage_bills")
def _p4(spark, sf_dir):
    return _bills(spark, sf_dir).staged


@query("k2_harvested_calendar")
def _k2(spark, sf_dir):
    return _bills(spark, sf_dir).dim_date


@query("k4_channel_keys")
def _k4(spark, sf_dir):
    return _bills(spark, sf_dir).dim_channel


@query("k4_biller_keys")
def _k4b(spark, sf_dir):
    return _bills(spark, sf_dir).dim_biller


@query("k4_dense_keys_over_customers")
def _k4c(spark, sf_dir):
    """Dense keys over a set that grows with the data."""
    members = driver.table(spark, sf_dir, "customer").select("c_mktsegment", "c_name")
    return numbering.with_dense_key(members, "member_key", ["c_mktsegment", "c_name"])


@query("k13_bill_fact")
def _k13(spark, sf_dir):
    return _bills(spark, sf_dir).fact


@query("k14_report_view")
def _k14(spark, sf_dir):
    report = _bills(spark, sf_dir).report
    report.createOrReplaceTempView("vw_transaction_report")
    return spark.table("vw_transaction_report")


@query("k10_bill_references")
def _k10(spark, sf_dir):
    """References of all facts against dimensions that lack their first channel and biller."""
    wh = _faulty_bills(spark, sf_dir)
    fact = wh.fact
    short = bills.BillWarehouse(spark, wh.raw, wh.staged)
    short.fact, short.dim_date = fact, wh.dim_date
    short.dim_channel = wh.dim_channel.filter("channel_key <> 2")
    short.dim_biller = wh.dim_biller.filter("biller_key <> 2")
    return short.reference_gate()


@query("q3_bill_staging_gate")
def _q3(spark, sf_dir):
    return bills.staging_gate(_bills(spark, sf_dir).staged)


@query("q4_bill_load_check")
def _q4(spark, sf_dir):
    return _whole(_faulty_bills(spark, sf_dir).load_check())


# -- hospitals ----------------------------------------------------------------


def _access(spark, sf_dir):
    return trauma.hospital_access(_hospitals(spark, sf_dir))


@query("p5_stage_hospitals")
def _p5(spark, sf_dir):
    return _hospitals(spark, sf_dir)


@query("h3_a_hospital_access")
def _h3a(spark, sf_dir):
    return _access(spark, sf_dir).withColumn("distance_km", F.col("distance_km").cast("double"))


query("h3_b_state_summary")(_over(trauma.state_summary, _access))
query("h3_c4_farthest")(_over(trauma.farthest, _access))
query("h3_c5_distance_by_type")(_over(trauma.distance_by_type, _access))
query("n_6_national_distance")(_over(trauma.national_distance, _access))
query("q7_unmapped_designations")(_over(trauma.unmapped_designations, driver.hospitals))
query("q8_null_profile")(_over(trauma.null_profile, _hospitals))
query("q9_category_distribution")(_over(trauma.category_distribution, _hospitals))
query("q11_distance_gate")(_over(trauma.distance_gate, _access))


@query("q10_row_check")
def _q10(spark, sf_dir):
    staged = _hospitals(spark, sf_dir)
    return _whole(trauma.row_check(staged, trauma.hospital_access(staged)))


@query("q14_summary_check")
def _q14(spark, sf_dir):
    return trauma.summary_check(trauma.state_summary(_access(spark, sf_dir)))


# -- retail -------------------------------------------------------------------

for _name, _build in {
    "c_1_monthly_growth": retail.monthly_growth,
    "c_2_stores": retail.stores,
    "c_3_weekday_weekend": retail.weekday_weekend,
    "c_4_hour_profile": retail.hour_profile,
    "c_4_day_part_shares": retail.day_part_shares,
}.items():
    query(_name)(_over(_build, driver.retail_lines))


def _sales(spark, sf_dir):
    return driver.retail_lines(spark, sf_dir), driver.retail_items(spark, sf_dir)


@query("c_5_top_by_quantity")
def _c5(spark, sf_dir):
    return retail.top_products(*_sales(spark, sf_dir), by="quantity", k=20)


@query("c_5_top_by_revenue")
def _c5b(spark, sf_dir):
    return retail.top_products(*_sales(spark, sf_dir), by="revenue", k=20)


@query("c_5_category_shares")
def _c5c(spark, sf_dir):
    return retail.category_shares(*_sales(spark, sf_dir))


@query("n_9_leaders_compared")
def _n9(spark, sf_dir):
    return retail.leaders_compared(*_sales(spark, sf_dir), k=10)


# -- single operators over the driver tables ----------------------------------


@query("a2_a5_conditional_aggregates")
def _a2(spark, sf_dir):
    """Conditional counts and sums; the share has no value where its denominator is zero."""
    d = driver.table(spark, sf_dir, "documents")
    marked = d.join(driver.table(spark, sf_dir, "labels"), "doc_id", "left")
    return marked.groupBy("lang", "source").agg(
        rows().alias("documents"),
        F.count("toxic").alias("labelled"),
        rows_where(F.col("toxic") == 1).alias("toxic_docs"),
        sum_where(F.col("n_chars"), F.col("toxic") == 1).alias("toxic_chars"),
        ratio(rows_where(F.col("toxic") == 1), F.count("toxic")).alias("toxic_share"),
    )


@query("a8_distinct_row_values")
def _a8(spark, sf_dir):
    """Row values with missing parts count; a plain multi-column count would skip them."""
    p = driver.table(spark, sf_dir, "part").withColumn("b", F.nullif("p_brand", F.lit("Brand#7")))
    return p.groupBy("p_size").agg(
        F.count_distinct(F.struct("p_name", "b", "p_type")).alias("row_values"),
        F.count_distinct("p_name", "b", "p_type").alias("complete_values"),
    )


@query("a10_exact_median")
def _a10(spark, sf_dir):
    return driver.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.percentile("l_quantity", 0.5).alias("median_quantity"), rows().alias("n")
    )


@query("a12_rollup_with_total")
def _a12(spark, sf_dir):
    return driver.table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(
        F.grouping("o_orderpriority").cast("long").alias("is_total"),
        rows().alias("orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"),
    )


@query("a13_having")
def _a13(spark, sf_dir):
    return (
        driver.table(spark, sf_dir, "orders").groupBy("o_custkey")
        .agg(rows_where(F.col("o_orderstatus") == "P").alias("pending"), rows().alias("orders"))
        .filter(F.col("pending") > 5)
    )


@query("w1_w2_share_of_total")
def _w1(spark, sf_dir):
    totals = driver.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        rows().alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value")
    )
    totals = with_share(totals, "orders", "share_of_orders", 2)
    return with_share(totals, "value", "share_of_value", 2)


@query("w3_share_within_group")
def _w3(spark, sf_dir):
    totals = driver.table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(rows().alias("n"))
    return with_share(totals, "n", "share_pct", 1, within=["event_type"])


@query("w4_group_size_on_rows")
def _w4(spark, sf_dir):
    p = driver.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.nullif("p_type", F.lit("PROMO")).alias("kind"))
    key = ["p_name", "p_brand", "kind"]
    sizes = p.groupBy(*key).agg(rows().alias("group_rows"))
    return joins.salted_join(
        p, sizes, key, ["p_partkey"], key_counts=sizes.withColumnRenamed("group_rows", "count"), null_safe=True
    ).select("p_partkey", "group_rows")


@query("w5_distributed_ntile")
def _w5(spark, sf_dir):
    orders = driver.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    tiled = numbering.with_tile(orders, 100, [F.desc("price"), F.asc("o_orderkey")], "tile")
    return tiled.groupBy("tile").agg(
        rows().alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"), F.sum("o_orderkey").alias("key_sum")
    )


@query("w5_tiles_from_value_counts")
def _w5_counts(spark, sf_dir):
    """A third of all orders have one price, which several tiles' ends cut."""
    orders = driver.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 1000).otherwise(F.col("o_totalprice")).cast("decimal(18,2)").alias("price")
    )
    tiled = order_statistics.with_tile_by_value(orders, 100, "price", "o_orderkey", "tile", descending=True)
    return tiled.groupBy("tile").agg(
        rows().alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"), F.sum("o_orderkey").alias("key_sum")
    )


@query("a10_quantiles_of_a_hot_group")
def _a10_hot(spark, sf_dir):
    """Prices have any number of values, and one group has a third of all rows."""
    lines = driver.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_suppkey")).alias("who"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    )
    found = None
    for share in (0.5, 0.9):
        one = order_statistics.quantile(lines, ["who"], "price", share, "q")
        one = one.select("who", F.lit(share).alias("share"), F.round(F.col("q") * 100).cast("long").alias("cents"))
        found = one if found is None else found.unionByName(one)
    return found


def _order_days(spark, sf_dir):
    """Calendar over the order dates with each day's value, quiet days included."""
    orders = driver.table(spark, sf_dir, "orders").select(
        calendar.date_key(F.col("o_orderdate").cast("date")).alias("date_key"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    first, last = orders.agg(F.min("date_key"), F.max("date_key")).first()
    span = [f"{key // 10000:04d}-{key // 100 % 100:02d}-{key % 100:02d}" for key in (first or 19950101, last or 19950101)]
    days = F.broadcast(calendar.generated_calendar(spark, *span))
    return periods.daily_totals(days, orders, {"value": F.sum("price"), "orders": rows()})


@query("w6_w12_order_calendar")
def _w6(spark, sf_dir):
    rolling = periods.trailing_days("value", "full_date", 30)
    return _order_days(spark, sf_dir).select(
        "full_date", "value",
        periods.to_date("value", "full_date", ["year", "month"]).alias("mtd"),
        periods.to_date("value", "full_date", ["year"]).alias("ytd"),
        rolling.alias("rolling_30d"),
        ratio(rolling, F.lit(30)).alias("rolling_30d_avg"),
        periods.running_total("value", "full_date").alias("running"),
    )


@query("w8_w9_orders_against_prior_year")
def _w8(spark, sf_dir):
    years = _order_days(spark, sf_dir).groupBy(F.trunc("full_date", "year").alias("start")).agg(F.sum("value").alias("value"))
    both = periods.with_prior_year(years, "start", ["value"], "_py")
    return both.select("start", "value", "value_py", ratio(F.col("value") - F.col("value_py"), F.col("value_py")).alias("yoy"))


@query("w13_month_on_month")
def _w13(spark, sf_dir):
    months = _order_days(spark, sf_dir).groupBy("month_start").agg(F.sum("value").alias("value"))
    return months.select(
        "month_start", "value",
        periods.change_from_previous("value", "month_start").alias("mom_pct"),
        periods.change_from_first("value", "month_start").alias("growth_pct"),
    )


@query("o4_top_customers")
def _o4(spark, sf_dir):
    return (
        driver.table(spark, sf_dir, "orders").groupBy("o_custkey")
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"), rows().alias("orders"))
        .orderBy(F.desc("value"), "o_custkey").limit(10)
    )


@query("o6_three_dimensions_one_scan")
def _o6(spark, sf_dir):
    orders = driver.table(spark, sf_dir, "orders")
    totals = split_by_dimensions(
        orders,
        {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus"), "weekday": calendar.day_name(F.col("o_orderdate"))},
        {"orders": rows(), "filled": rows_where(F.col("o_orderstatus") == "F")},
    )
    return totals.select("dimension", "segment", "orders", percent(F.col("filled"), F.col("orders"), 2).alias("filled_pct"))


@query("x1_x9_text_to_values")
def _x1(spark, sf_dir):
    """Text built from keys and parsed back: money, rounded numbers, lists, words, months, sentinels."""
    c = F.col("c_custkey")
    raw = driver.table(spark, sf_dir, "customer").select(
        c,
        F.concat(F.lit("$"), F.when(c % 3 == 0, "-").otherwise(""), c.cast("string"), F.lit(".50")).alias("money"),
        F.concat((c % 99999).cast("string"), F.lit("."), (c % 10).cast("string")).alias("zip"),
        F.when(c % 4 == 0, "").when(c % 4 == 1, F.concat(F.lit("a, b"), c.cast("string"))).otherwise("x").alias("listed"),
        F.concat(F.lit("Word"), (c % 7).cast("string"), F.lit(" tail")).alias("words"),
        F.concat(F.lpad((1 + c % 12).cast("string"), 2, "0"), F.lit("/"), (2000 + c % 20).cast("string")).alias("month"),
        F.when(c % 5 == 0, "-999").otherwise(c.cast("string")).alias("beds"),
        F.when(c % 3 == 0, "Y").when(c % 3 == 1, "N").otherwise("?").alias("pad"),
    )
    return raw.select(
        "c_custkey",
        text.money(F.col("money")).alias("amount"),
        text.whole_number(F.col("zip")).alias("zip"),
        F.size(text.comma_list(F.col("listed"))).alias("items"),
        text.first_word(F.col("words")).alias("word"),
        text.month_year(F.col("month")).alias("month"),
        text.absent(F.col("beds"), "-999").cast("int").alias("beds"),
        text.yes_no(F.col("pad")).alias("has_pad"),
    )


@query("x10_x15_date_parts")
def _x10(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    days = driver.table(spark, sf_dir, "orders").groupBy(d.alias("d")).agg(rows().alias("n"))
    d = F.col("d")
    return days.select(
        "d", "n",
        calendar.date_key(d).alias("date_key"),
        calendar.iso_weekday(d).alias("iso_weekday"),
        calendar.sunday_zero_weekday(d).alias("sunday_zero"),
        calendar.day_name(d).alias("day_name"),
        calendar.month_name(d).alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.trunc(d, "month").alias("month_start"),
    )


@query("x19_haversine")
def _x19(spark, sf_dir):
    c = F.col("c_custkey")
    km = haversine_km(
        (2500 + (c * 37) % 2400) / F.lit(100), (-12400 + (c * 91) % 5700) / F.lit(100), F.lit(38.9), F.lit(-77.04)
    )
    return driver.table(spark, sf_dir, "customer").select("c_custkey", F.round(km, 3).alias("km"))


# -- sources and sinks: files written from the tables, read back and staged ----


@query("s1_csv_scan_and_stage")
def _s1(spark, sf_dir):
    path = scratch_path(spark, "transactions")
    driver.card_transactions(spark, sf_dir).write.option("header", True).option("emptyValue", '""').csv(path)
    raw = readers.read_delimited(spark, path, schemas.TRANSACTIONS)
    typed = cw.type_transactions(raw)
    return typed.groupBy("channel", "is_failed").agg(
        rows().alias("n"), F.sum("amount").alias("amount"), F.count("zip").alias("zips"), F.sum("zip").alias("zip_sum"),
        F.min("transaction_date").alias("first_day"), F.max("transaction_date").alias("last_day"),
    )


@query("s1_quoted_line_breaks")
def _s1_breaks(spark, sf_dir):
    """Texts with line breaks, quotes and commas, written as CSV and read by as many tasks as the files have splits."""
    path = scratch_path(spark, "texts")
    texts = driver.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    texts.write.option("header", True).option("emptyValue", '""').option("escape", '"').csv(path)
    back = readers.read_delimited(spark, path, schemas.text_schema("doc_id lang text"), line_breaks=True)
    return back.select("doc_id", "lang", F.md5("text").alias("md5"), F.length("text").alias("length"))


@query("s3_required_columns")
def _s3(spark, sf_dir):
    """Which columns a bill file without two of them lacks, next to the rows it would have brought."""
    path = scratch_path(spark, "short_bills")
    names = {new: old for old, new in schemas.BILLS_RENAMED.items()}
    short = driver.bill_payments(spark, sf_dir).drop("channel", "status").withColumnsRenamed(names)
    short.write.option("header", True).option("sep", ";").csv(path)
    found = spark.read.option("header", True).option("sep", ";").csv(path)
    missing = readers.missing_columns(found.columns, schemas.BILLS_FILE.fieldNames())
    wanted = literal_table(spark, [(n, n in missing) for n in schemas.BILLS_FILE.fieldNames()], "column_name string, is_missing boolean")
    return wanted.crossJoin(found.agg(rows().alias("file_rows")))  # one row


@query("s7_texts_with_commas_and_escapes")
def _s7_texts(spark, sf_dir):
    """One JSON object whose texts hold commas, quotes, backslashes and line breaks, read in parallel."""
    path = scratch_path(spark, "object")
    text = F.to_json(F.array("text"))
    pairs = driver.table(spark, sf_dir, "documents").select(
        F.concat(F.lit('"'), "doc_id", F.lit('": '), F.substring(text, F.lit(2), F.length(text) - 2), F.lit(",")).alias("value")
    )
    pairs.write.text(path)
    return readers.read_code_map(spark, path).select(F.col("mcc").alias("doc_id"), F.md5("description").alias("md5"))


@query("s2_semicolon_csv_bills")
def _s2(spark, sf_dir):
    path = scratch_path(spark, "bills")
    names = {new: old for old, new in schemas.BILLS_RENAMED.items()}
    driver.bill_payments(spark, sf_dir).withColumnsRenamed(names).write.option("header", True).option("sep", ";").option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return bills.stage_bills(readers.read_bills(spark, path)).drop("nama_nasabah")


@query("s5_cards_without_sensitive_columns")
def _s5(spark, sf_dir):
    path = scratch_path(spark, "cards")
    driver.card_cards_file(spark, sf_dir).write.option("header", True).csv(path)
    return cw.stage_cards(readers.read_card_file(spark, path))


@query("s6_code_map_to_rows")
def _s6(spark, sf_dir):
    """One JSON object {code: description} with a code per part size, as there are at most 50 of them."""
    path = scratch_path(spark, "codes")
    sizes = driver.table(spark, sf_dir, "part").groupBy("p_size").agg(rows().alias("n"), F.max("p_name").alias("last"))
    one = sizes.agg(
        F.to_json(
            F.map_from_entries(
                F.collect_list(
                    F.struct(
                        (F.col("p_size") + 5800).cast("string"),
                        F.concat(F.col("n").cast("string"), F.lit(' parts, "'), "last", F.lit('"')),
                    )
                )
            )
        ).alias("value")
    )
    one.write.text(path)
    return cw.mcc_dimension(readers.read_code_map(spark, path))


@query("s7_label_object_to_rows")
def _s7(spark, sf_dir):
    path = scratch_path(spark, "labels")
    pairs = driver.card_labels(spark, sf_dir).select(
        F.concat(F.lit('"'), "transaction_id", F.lit('": "'), "is_fraud", F.lit('",')).alias("value")
    )
    pairs.write.text(path)
    found = readers.read_label_object(spark, path)
    return found.groupBy("is_fraud").agg(
        rows().alias("n"), F.sum(F.col("transaction_id").cast("long")).alias("id_sum")
    )


@query("s8_s9_publish_and_read_back")
def _s8(spark, sf_dir):
    """The warehouse published twice (a re-run replaces it), read back through the year folders."""
    wh = _card(spark, sf_dir)
    root = scratch_path(spark, "warehouse")
    for _ in range(2):
        publish.publish_layer(
            spark, root,
            {"fact": publish.Landing(
                wh.charges.withColumn("year", F.floor(F.col("date_key") / 10000).cast("int")), partition_by=("year",)
            )},
        )
    fact = publish.read_published(spark, root, "fact")
    return fact.filter(F.col("year") >= 2017).groupBy("year").agg(rows().alias("n"), F.sum("amount").alias("amount"))


@query("s15_csv_export")
def _s15(spark, sf_dir):
    """The monthly bill report exported as one file with quoted text, and read back as text."""
    path = scratch_path(spark, "export")
    publish.export_csv(bills.revenue_per_month(_bill_report(spark, sf_dir)), path, ["year", "month_name"])
    back = readers.read_delimited(
        spark, path, schemas.text_schema("year month_name settled_transactions gmv net_revenue take_rate_pct")
    )
    return back.selectExpr(
        "CAST(year AS BIGINT) AS year", "month_name", "CAST(gmv AS BIGINT) AS gmv",
        "CAST(net_revenue AS BIGINT) AS net_revenue", "CAST(take_rate_pct AS DOUBLE) AS take_rate_pct",
    )
