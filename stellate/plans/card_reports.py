"""Card leakage, fraud and portfolio reports. Each takes the warehouse and returns one report frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.functions.rates import (
    mean_from, percent, ratio, rows, rows_where, sum_where, whole_units,
)
from stellate.operators.order_statistics import with_tile_by_value
from stellate.operators.shares import with_share
from stellate.operators.star import totals_by_attribute, totals_by_label
from stellate.plans.card_warehouse import STALE_CREDENTIAL, CardWarehouse, bridge_of, has_any_error

# Categories that bill a stored card, evening hours, first day after the liability shift.
CARD_ON_FILE = ("Transport & Travel", "Utilities & Telecom", "Digital & Entertainment")
EVENING = (17, 19)
ERA_CUT = 20151001


def _amount() -> Column:
    return F.col("abs_amount")


def _fraud() -> Column:
    return F.col("is_fraud")


def _clean() -> Column:
    """Labelled and not fraud: an unlabelled row is unknown, not clean."""
    return F.col("has_fraud_label") & ~F.col("is_fraud")


def _failures() -> dict[str, Column]:
    return {
        "transactions": rows(),
        "failed": rows_where(F.col("is_failed")),
        "failed_value": sum_where(_amount(), F.col("is_failed")),
    }


def _frauds() -> dict[str, Column]:
    return {
        "labelled": rows_where(F.col("has_fraud_label")),
        "fraud_txns": rows_where(_fraud()),
        "fraud_loss": sum_where(_amount(), _fraud()),
    }


def _tickets() -> dict[str, Column]:
    return {"clean_txns": rows_where(_clean()), "clean_value": sum_where(_amount(), _clean())}


def _agg(df: DataFrame, parts: dict[str, Column], *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in parts.items()])


def _failure_rate() -> Column:
    return percent(F.col("failed"), F.col("transactions"), 3).alias("failure_rate_pct")


def _failed_value() -> Column:
    return whole_units(F.col("failed_value")).alias("failed_value_usd")


def _fraud_rate() -> Column:
    return percent(F.col("fraud_txns"), F.col("labelled"), 4).alias("fraud_rate_pct")


def _fraud_loss() -> Column:
    return whole_units(F.col("fraud_loss")).alias("fraud_loss_usd")


# -- failed transactions ------------------------------------------------------


def leakage_by_year(wh: CardWarehouse) -> DataFrame:
    return (
        totals_by_label(wh.window_charges, wh.dim_date, "date_key", ["year"], _failures())
        .select("year", "transactions", "failed", _failure_rate(), _failed_value())
        .orderBy("year")
    )


def _window_errors(wh: CardWarehouse, *carried: str) -> DataFrame:
    return bridge_of(wh.window_charges, *carried).join(F.broadcast(wh.dim_error), "error_key")


def failures_by_error(wh: CardWarehouse) -> DataFrame:
    """Value counts once per error: a transaction with two errors is in two rows."""
    totals = totals_by_label(
        bridge_of(wh.window_charges, "abs_amount"),
        wh.dim_error,
        "error_key",
        ["fault_owner", "error_name"],
        {"occurrences": rows(), "value": F.sum(_amount())},
    )
    return (
        with_share(totals, "occurrences", "pct_of_failures", 2)
        .select("fault_owner", "error_name", "occurrences", whole_units(F.col("value")).alias("value_usd"), "pct_of_failures")
        .orderBy(F.desc("occurrences"), "error_name")
    )


def failures_by_fault_owner(wh: CardWarehouse) -> DataFrame:
    """The three owners with their value per error and its share."""
    totals = totals_by_label(
        bridge_of(wh.window_charges, "abs_amount"),
        wh.dim_error,
        "error_key",
        ["fault_owner"],
        {"occurrences": rows(), "value": F.sum(_amount())},
    )
    return (
        with_share(totals, "value", "pct_of_value", 1)
        .select("fault_owner", "occurrences", whole_units(F.col("value")).alias("value_usd"), "pct_of_value")
        .orderBy(F.desc("value_usd"), "fault_owner")
    )


def failure_by_channel(wh: CardWarehouse) -> DataFrame:
    return (
        totals_by_label(wh.window_charges, wh.dim_channel, "channel_key", ["channel_name"], _failures())
        .select("channel_name", "transactions", _failure_rate(), _failed_value())
        .orderBy(F.desc_nulls_last("failure_rate_pct"), "channel_name")
    )


def expired_card_declines(wh: CardWarehouse) -> DataFrame:
    expired = wh.window_charges.filter(has_any_error("Bad Expiration"))
    return (
        expired.join(F.broadcast(wh.dim_date.select("date_key", "year")), "date_key")
        .groupBy("year")
        .agg(
            rows().alias("expired_card_declines"),
            whole_units(F.sum(_amount())).alias("value_usd"),
            F.count_distinct("card_id").alias("cards_affected"),
        )
        .orderBy("year")
    )


def failure_by_category(wh: CardWarehouse) -> DataFrame:
    return (
        totals_by_label(wh.window_charges, wh.dim_mcc, "mcc", ["spend_category"], _failures())
        .select("spend_category", "transactions", _failure_rate(), _failed_value())
        .orderBy(F.desc_nulls_last("failed_value_usd"), "spend_category")
    )


def _category_errors(wh: CardWarehouse) -> DataFrame:
    return (
        _window_errors(wh, "mcc")
        .join(F.broadcast(wh.dim_mcc), "mcc")
        .groupBy("spend_category", "error_name")
        .agg(rows().alias("occurrences"))
    )


def error_mix_by_category(wh: CardWarehouse) -> DataFrame:
    mix = with_share(
        _category_errors(wh), "occurrences", "pct_within_category", 1, within=["spend_category"]
    )
    return mix.orderBy("spend_category", F.desc("occurrences"), "error_name")


def error_mix_side_by_side(wh: CardWarehouse, categories: tuple[str, str]) -> DataFrame:
    """The mix of two categories as columns, one row per error."""
    mix = with_share(
        _category_errors(wh).filter(F.col("spend_category").isin(*categories)),
        "occurrences", "pct", 1, within=["spend_category"],
    )
    return (
        mix.groupBy("error_name")
        .pivot("spend_category", list(categories))
        .agg(F.max("pct"))
        .select("error_name", *[F.col(f"`{c}`").alias(f"pct_{i}") for i, c in enumerate(categories, 1)])
        .orderBy("error_name")
    )


def stale_declines_by_category(wh: CardWarehouse) -> DataFrame:
    """Per error occurrence, with a grand-total row (NULL category) on top."""
    stale = _window_errors(wh, "mcc", "card_id", "abs_amount").filter(
        F.col("error_name").isin(*STALE_CREDENTIAL)
    )
    return (
        stale.join(F.broadcast(wh.dim_mcc), "mcc")
        .rollup("spend_category")
        .agg(
            rows().alias("stale_credential_declines"),
            whole_units(F.sum(_amount())).alias("value_usd"),
            F.count_distinct("card_id").alias("cards_affected"),
            F.grouping("spend_category").cast("int").alias("is_total"),
        )
        .orderBy(F.desc("is_total"), F.desc("value_usd"), "spend_category")
    )


def _stale() -> Column:
    return has_any_error(*STALE_CREDENTIAL)


def _stale_totals(wh: CardWarehouse, *by: str, **columns: Column) -> DataFrame:
    codes = wh.dim_mcc.withColumns(columns) if columns else wh.dim_mcc
    return totals_by_label(
        wh.window_charges, codes, "mcc", list(by),
        {"transactions": rows(), "stale_credential": rows_where(_stale())},
    )


def stale_rate_by_segment(wh: CardWarehouse) -> DataFrame:
    """Each transaction counts once, however many stale reasons it carries."""
    segment = F.when(F.col("spend_category").isin(*CARD_ON_FILE), "Card-on-file").otherwise("Card-present")
    return (
        _stale_totals(wh, "segment", segment=segment)
        .select(
            "segment", "transactions", "stale_credential",
            percent(F.col("stale_credential"), F.col("transactions"), 4).alias("rate_pct"),
        )
        .orderBy("segment")
    )


def stale_by_category(wh: CardWarehouse) -> DataFrame:
    return _stale_totals(wh, "spend_category").orderBy(
        "stale_credential", F.desc("transactions"), "spend_category"
    )


def stale_per_month(wh: CardWarehouse) -> DataFrame:
    return (
        totals_by_label(
            wh.window_charges.filter(_stale()),
            wh.dim_date,
            "date_key",
            ["month_start"],
            {"stale_credential": rows(), "value": F.sum(_amount())},
        )
        .select("month_start", "stale_credential", whole_units(F.col("value")).alias("value_usd"))
        .orderBy("month_start")
    )


def issuer_value_per_year(wh: CardWarehouse) -> DataFrame:
    """Issuer-owned value over the window, spread over its months and scaled to a year."""
    issuer = _window_errors(wh, "date_key", "abs_amount").filter(F.col("fault_owner") == "Issuer")
    bounds = wh.window_charges.agg(
        F.min("date_key").alias("first_key"), F.max("date_key").alias("last_key")
    )
    month_no = lambda key: F.floor(F.col(key) / 10000) * 12 + F.floor(F.col(key) / 100) % 100
    totals = issuer.agg(F.sum(_amount()).alias("issuer_value")).withColumn("one", F.lit(1))
    months = bounds.select(
        F.lit(1).alias("one"), (month_no("last_key") - month_no("first_key") + 1).cast("long").alias("months")
    )
    return totals.join(F.broadcast(months), "one").select(
        whole_units(F.col("issuer_value")).alias("issuer_value_usd"),
        "months",
        whole_units(
            F.try_divide(F.col("issuer_value").cast("decimal(24,2)") * 12, F.col("months").cast("decimal(10,0)"))
        ).alias("value_per_year_usd"),
    )


# -- fraud --------------------------------------------------------------------


def label_coverage(wh: CardWarehouse) -> DataFrame:
    """The right denominator next to the wrong one."""
    totals = _agg(wh.window_fact, {"all_rows": rows(), **_frauds()})
    return totals.select(
        "all_rows",
        F.col("labelled").alias("labelled_rows"),
        percent(F.col("labelled"), F.col("all_rows"), 1).alias("label_coverage_pct"),
        F.col("fraud_txns").alias("fraud_rows"),
        _fraud_rate(),
        percent(F.col("fraud_txns"), F.col("all_rows"), 4).alias("wrong_denominator_pct"),
    )


def fraud_by_channel(wh: CardWarehouse) -> DataFrame:
    return (
        totals_by_label(
            wh.window_fact, wh.dim_channel, "channel_key", ["channel_name"], {**_frauds(), **_tickets()}
        )
        .select(
            "channel_name", "labelled", "fraud_txns", _fraud_rate(), _fraud_loss(),
            mean_from(F.col("fraud_loss"), F.col("fraud_txns"), 2).alias("avg_fraud_ticket"),
            mean_from(F.col("clean_value"), F.col("clean_txns"), 2).alias("avg_clean_ticket"),
        )
        .orderBy(F.desc_nulls_last("fraud_rate_pct"), "channel_name")
    )


def fraud_by_category(wh: CardWarehouse) -> DataFrame:
    return (
        totals_by_label(wh.window_fact, wh.dim_mcc, "mcc", ["spend_category"], _frauds())
        .filter(F.col("fraud_txns") > 0)
        .select("spend_category", "fraud_txns", _fraud_rate(), _fraud_loss())
        .orderBy(F.desc_nulls_last("fraud_rate_pct"), "spend_category")
    )


def fraud_by_ticket_band(wh: CardWarehouse) -> DataFrame:
    """Bands come from the dimension; the label carries its number as in '2. $25-100'."""
    numbered = wh.dim_ticket_band.select(
        "ticket_band_key",
        F.concat(F.col("ticket_band_key").cast("string"), F.lit(". "), "ticket_band").alias("ticket_band"),
    )
    return (
        totals_by_label(wh.window_fact, numbered, "ticket_band_key", ["ticket_band"], _frauds())
        .select("ticket_band", "labelled", "fraud_txns", _fraud_rate(), _fraud_loss())
        .orderBy("ticket_band")
    )


def loss_concentration(wh: CardWarehouse) -> DataFrame:
    """Labelled tickets in 100 tiles by size; equal sizes are ordered by transaction id.

    Sizes are counted, not sorted row by row; only tickets of a size that a tile's end cuts are numbered.
    """
    labelled = wh.window_fact.filter("has_fraud_label").select("transaction_id", "abs_amount", "is_fraud")
    ranked = with_tile_by_value(labelled, 100, "abs_amount", "transaction_id", "pct_rank", descending=True)
    tile = F.col("pct_rank")
    piece = (
        F.when(tile <= 1, "Top 1% by ticket size")
        .when(tile <= 5, "Top 5%")
        .when(tile <= 10, "Top 10%")
        .otherwise("Remaining 90%")
    )
    return (
        ranked.groupBy(piece.alias("slice"))
        .agg(
            rows().alias("transactions"),
            rows_where(_fraud()).alias("fraud_txns"),
            whole_units(sum_where(_amount(), _fraud())).alias("fraud_loss_usd"),
            F.min("pct_rank").alias("_first"),
        )
        .orderBy("_first")
        .drop("_first")
    )


def _by_hour(wh: CardWarehouse) -> DataFrame:
    """24 rows that every hour report starts from."""
    return _agg(wh.window_fact, {"transactions": rows(), **_frauds()}, "hour_of_day")


def worst_hours(wh: CardWarehouse, k: int = 8) -> DataFrame:
    return (
        _by_hour(wh)
        .select("hour_of_day", "fraud_txns", _fraud_rate())
        .orderBy(F.desc_nulls_last("fraud_rate_pct"), "hour_of_day")
        .limit(k)
    )


def _evening(wh: CardWarehouse) -> DataFrame:
    block = F.when(F.col("hour_of_day").between(*EVENING), "Evening 17-19").otherwise("All other hours")
    return (
        _by_hour(wh)
        .groupBy(block.alias("block"))
        .agg(*[F.sum(c).alias(c) for c in ("transactions", "labelled", "fraud_txns", "fraud_loss")])
    )


def evening_block(wh: CardWarehouse) -> DataFrame:
    return (
        _evening(wh)
        .select("block", "labelled", "fraud_txns", _fraud_rate(), _fraud_loss())
        .orderBy(F.desc_nulls_last("fraud_rate_pct"), "block")
    )


def evening_shares(wh: CardWarehouse) -> DataFrame:
    shares = with_share(_evening(wh), "transactions", "pct_of_transactions", 1)
    shares = with_share(shares, "fraud_txns", "pct_of_fraud", 1)
    return shares.select("block", "transactions", "pct_of_transactions", "fraud_txns", "pct_of_fraud").orderBy("block")


def segment_ratios(wh: CardWarehouse) -> DataFrame:
    """How many times one segment's rate is the other's, as one row."""
    pieces = [
        ("stale_on_file_vs_present", stale_rate_by_segment(wh), "segment", "Card-on-file", "stale_credential", "transactions"),
        ("fraud_evening_vs_rest", _evening(wh), "block", "Evening 17-19", "fraud_txns", "labelled"),
    ]
    found = None
    for name, frame, label, top, part, whole in pieces:
        is_top = F.col(label) == top
        rate = lambda cond: ratio(F.sum(F.when(cond, F.col(part))), F.sum(F.when(cond, F.col(whole))))
        one = frame.agg(F.try_divide(rate(is_top), rate(~is_top)).alias("times")).select(F.lit(name).alias("comparison"), "times")
        found = one if found is None else found.unionByName(one)
    tickets = _agg(wh.window_fact, {**_frauds(), **_tickets()}).select(
        F.lit("fraud_ticket_vs_clean").alias("comparison"),
        F.try_divide(
            ratio(F.col("fraud_loss"), F.col("fraud_txns")), ratio(F.col("clean_value"), F.col("clean_txns"))
        ).alias("times"),
    )
    return found.unionByName(tickets)


def fraud_by_card_type(wh: CardWarehouse) -> DataFrame:
    return (
        totals_by_attribute(wh.window_fact, wh.dim_card, "card_id", ["card_type"], _frauds())
        .select("card_type", "labelled", "fraud_txns", _fraud_rate())
        .orderBy(F.desc_nulls_last("fraud_rate_pct"), "card_type")
    )


def ticket_size_signal(wh: CardWarehouse) -> DataFrame:
    totals = _agg(wh.window_fact, {**_frauds(), **_tickets()})
    cross = F.try_divide(
        F.col("fraud_loss").cast("decimal(20,2)") * F.col("clean_txns").cast("decimal(14,0)"),
        F.col("fraud_txns").cast("decimal(14,0)") * F.col("clean_value").cast("decimal(20,2)"),
    )
    return totals.select(
        mean_from(F.col("fraud_loss"), F.col("fraud_txns"), 2).alias("avg_fraud_ticket"),
        mean_from(F.col("clean_value"), F.col("clean_txns"), 2).alias("avg_clean_ticket"),
        F.round(cross.cast("decimal(38,10)"), 2).cast("double").alias("ratio"),
    )


# -- portfolio ----------------------------------------------------------------


def leakage_by_credit_band(wh: CardWarehouse) -> DataFrame:
    parts = {**_failures(), **_frauds(), "spend": F.sum(_amount())}
    return (
        totals_by_attribute(
            wh.window_fact, wh.dim_client, "client_id", ["credit_band", "credit_band_order"], parts, "clients"
        )
        .orderBy("credit_band_order")
        .select(
            "credit_band", "clients", "transactions", whole_units(F.col("spend")).alias("spend_usd"),
            _failure_rate(), _fraud_rate(),
        )
    )


def declines_by_debt_band(wh: CardWarehouse) -> DataFrame:
    parts = {**_failures(), "insufficient": rows_where(has_any_error("Insufficient Balance"))}
    return (
        totals_by_attribute(
            wh.window_charges, wh.dim_client, "client_id", ["dti_band", "dti_band_order"], parts, "clients"
        )
        .orderBy("dti_band_order")
        .select(
            "dti_band", "clients", _failure_rate(),
            percent(F.col("insufficient"), F.col("transactions"), 3).alias("insufficient_balance_pct"),
        )
    )


def utilisation_by_limit_band(wh: CardWarehouse) -> DataFrame:
    """Credit cards only; the average limit is taken over transactions, not over cards."""
    credit = wh.dim_card.filter(F.col("card_type") == "Credit")
    parts = {**_failures(), "spend": F.sum(_amount())}
    weighted = {"limit_total": F.sum(F.col("credit_limit").cast("long") * F.col("transactions"))}
    return (
        totals_by_attribute(
            wh.window_charges, credit, "card_id", ["limit_band", "limit_band_order"], parts, "cards", weighted
        )
        .orderBy("limit_band_order")
        .select(
            "limit_band", "cards", whole_units(F.col("spend")).alias("spend_usd"),
            mean_from(F.col("limit_total"), F.col("transactions"), 0).cast("long").alias("avg_limit"),
            _failure_rate(),
        )
    )


def by_brand_type_chip(wh: CardWarehouse) -> DataFrame:
    parts = {**_failures(), **_frauds()}
    return (
        totals_by_attribute(
            wh.window_fact, wh.dim_card, "card_id", ["card_brand", "card_type", "has_chip"], parts
        )
        .select("card_brand", "card_type", "has_chip", "transactions", _failure_rate(), _fraud_rate())
        .orderBy(F.desc("transactions"), "card_brand", "card_type", "has_chip")
    )


# -- is the source consistent? (whole history) --------------------------------


def channel_mix_by_year(wh: CardWarehouse) -> DataFrame:
    cells = (
        wh.charges.join(F.broadcast(wh.dim_date.select("date_key", "year")), "date_key")
        .join(F.broadcast(wh.dim_channel), "channel_key")
        .groupBy("year", "channel_name")
        .agg(rows().alias("n"))
    )
    names = ("Swipe", "Chip", "Online")
    wide = cells.groupBy("year").agg(
        F.sum("n").alias("transactions"),
        *[F.coalesce(F.sum(F.when(F.col("channel_name") == n, F.col("n"))), F.lit(0)).alias(n) for n in names],
    )
    return wide.select(
        "year",
        *[percent(F.col(n), F.col("transactions"), 1).alias(f"{n.lower()}_pct") for n in names],
        "transactions",
    ).orderBy("year")


def fraud_by_era_and_channel(wh: CardWarehouse) -> DataFrame:
    era = F.when(F.col("date_key") < ERA_CUT, "Before Oct 2015").otherwise("After Oct 2015")
    return (
        _agg(wh.fact.withColumn("era", era), _frauds(), "era", "channel_key")
        .join(F.broadcast(wh.dim_channel), "channel_key")
        .select("era", "channel_name", "labelled", _fraud_rate(), _fraud_loss())
        .orderBy("channel_name", F.desc("era"))
    )


def _yearly_fraud(wh: CardWarehouse) -> DataFrame:
    online = _fraud() & F.col("is_online")
    parts = {
        **_frauds(),
        "fraud_online": rows_where(online),
        "fraud_card_present": rows_where(_fraud() & ~F.col("is_online")),
        "online_loss": sum_where(_amount(), online),
    }
    return totals_by_label(wh.fact, wh.dim_date, "date_key", ["year"], parts)


def online_share_of_loss(wh: CardWarehouse) -> DataFrame:
    return (
        _yearly_fraud(wh)
        .select(
            "year",
            percent(F.col("online_loss"), F.col("fraud_loss"), 1).alias("online_share_of_fraud_loss_pct"),
            whole_units(F.col("fraud_loss")).alias("total_fraud_loss_usd"),
        )
        .orderBy("year")
    )


def label_regime_by_year(wh: CardWarehouse) -> DataFrame:
    return (
        _yearly_fraud(wh)
        .select("year", "labelled", "fraud_txns", _fraud_rate(), "fraud_online", "fraud_card_present", _fraud_loss())
        .orderBy("year")
    )
