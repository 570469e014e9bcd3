"""Named measures over the reporting window, evaluated for any grouping in one pass.

Base measures are additive parts of one aggregation; the others are built from
them afterwards. A grouping names dimension attributes. Dimensions with a fixed
key domain are broadcast; those that grow with the data are met only after the
fact has been reduced to their keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.functions.rates import ratio, rows, rows_where, sum_where
from stellate.operators import periods
from stellate.operators.distinct import distinct_keys, key_sets
from stellate.plans.card_warehouse import (
    ERRORS, STALE_CREDENTIAL, WINDOW_FIRST_DAY, CardWarehouse, has_any_error,
)

ISSUER_ERRORS = [name for _, name, owner in ERRORS if owner == "Issuer"]


def _value_where(flag: Column) -> Column:
    return sum_where(F.col("abs_amount"), flag)

BASE: dict[str, Callable[[], Column]] = {
    "transactions": rows,
    "total_spend": lambda: F.sum("amount"),
    "gross_spend": lambda: F.sum("abs_amount"),
    "refund_value": lambda: _value_where(F.col("is_refund")),
    "failed_transactions": lambda: rows_where(F.col("is_failed")),
    "failed_value": lambda: _value_where(F.col("is_failed")),
    "issuer_owned_failed_value": lambda: _value_where(F.col("is_failed") & has_any_error(*ISSUER_ERRORS)),
    "labelled_transactions": lambda: rows_where(F.col("has_fraud_label")),
    "fraud_transactions": lambda: rows_where(F.col("is_fraud")),
    "fraud_loss": lambda: _value_where(F.col("is_fraud")),
    "stale_credential_transactions": lambda: rows_where(has_any_error(*STALE_CREDENTIAL)),
    "stale_credential_value": lambda: _value_where(has_any_error(*STALE_CREDENTIAL)),
}

# Base measures that need the fraud label.
LABELLED = {"labelled_transactions", "fraud_transactions", "fraud_loss"}

DERIVED: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "avg_ticket": (("gross_spend", "transactions"), lambda: ratio(F.col("gross_spend"), F.col("transactions"))),
    "failure_rate": (
        ("failed_transactions", "transactions"),
        lambda: ratio(F.col("failed_transactions"), F.col("transactions")),
    ),
    "approval_rate": (("failure_rate",), lambda: F.lit(1.0) - F.coalesce(F.col("failure_rate"), F.lit(0.0))),
    "label_coverage": (
        ("labelled_transactions", "transactions"),
        lambda: ratio(F.col("labelled_transactions"), F.col("transactions")),
    ),
    "fraud_rate": (
        ("fraud_transactions", "labelled_transactions"),
        lambda: ratio(F.col("fraud_transactions"), F.col("labelled_transactions")),
    ),
    "avg_fraud_ticket": (
        ("fraud_loss", "fraud_transactions"),
        lambda: ratio(F.col("fraud_loss"), F.col("fraud_transactions")),
    ),
    "fraud_loss_bps": (
        ("fraud_loss", "gross_spend"),
        lambda: ratio(F.col("fraud_loss"), F.col("gross_spend")) * 10000,
    ),
    "stale_credential_rate": (
        ("stale_credential_transactions", "transactions"),
        lambda: ratio(F.col("stale_credential_transactions"), F.col("transactions")),
    ),
}

# Distinct counts do not add up over groups, so they keep their key until the last step.
DISTINCT = {"cards_with_stale_credential": ("card_id", "stale_credential_transactions")}

# Measures per calendar day in context.
PER_DAY = {"spend_per_day": "total_spend"}

ATTRIBUTES = {
    "year": "date_key", "quarter": "date_key", "month": "date_key", "month_start": "date_key",
    "full_date": "date_key", "day_name": "date_key", "is_weekend": "date_key",
    "channel_name": "channel_key", "is_card_present": "channel_key",
    "ticket_band": "ticket_band_key",
    "spend_category": "mcc",
    "country": "location_key", "state": "location_key", "is_domestic": "location_key",
    "card_type": "card_id", "card_brand": "card_id", "limit_band": "card_id",
    "credit_band": "client_id", "age_band": "client_id", "income_band": "client_id", "dti_band": "client_id",
}
_DIMENSION = {
    "date_key": "dim_date", "channel_key": "dim_channel", "ticket_band_key": "dim_ticket_band",
    "mcc": "dim_mcc", "location_key": "dim_location", "card_id": "dim_card", "client_id": "dim_client",
}

# Dimensions that grow with the data: met after the fact is reduced to their keys.
GROWING = {"location_key", "card_id", "client_id"}


# Time intelligence: what each measure is made from. They need a date attribute to stand on.
TIME = {
    "spend_mtd": "total_spend", "spend_ytd": "total_spend", "spend_running_total": "total_spend",
    "spend_rolling_30d": "total_spend", "spend_rolling_30d_avg": "total_spend",
    "spend_py": "total_spend", "spend_yoy": "total_spend",
    "failure_rate_py": "failure_rate", "failure_rate_yoy_pp": "failure_rate",
}
_DAILY = ["total_spend", "transactions", "failed_transactions"]

# Date attributes that a time measure can stand on, and the length of their periods.
GRAINS = {"full_date": "day", "month_start": "month", "year": "year"}


def names() -> list[str]:
    return [*BASE, *DERIVED, *DISTINCT, *PER_DAY, *TIME]


def _needed(measures: Sequence[str]) -> tuple[list[str], list[str]]:
    """Base measures to aggregate and derived ones in the order they build on each other."""
    base: list[str] = []
    derived: list[str] = []

    def visit(name: str) -> None:
        if name in BASE:
            if name not in base:
                base.append(name)
        elif name in DERIVED:
            for part in DERIVED[name][0]:
                visit(part)
            if name not in derived:
                derived.append(name)
        elif name in DISTINCT:
            visit(DISTINCT[name][1])
        elif name in PER_DAY:
            visit(PER_DAY[name])
        else:
            raise KeyError(f"no measure named {name!r}")

    for name in measures:
        visit(name)
    return base, derived


def evaluate(
    wh: CardWarehouse,
    measures: Sequence[str],
    by: Sequence[str] = (),
    where: Column | None = None,
    fact: DataFrame | None = None,
    filters: Mapping[str, Sequence[object]] | None = None,
) -> DataFrame:
    """One row per combination of ``by``, one column per measure.

    ``where`` filters the fact; ``filters`` gives dimension attributes the values they may have,
    and is applied to the dimension before the fact meets it. Time measures need exactly one of
    ``GRAINS`` among ``by``; they see every day of the window in every group.
    """
    filters = filters or {}
    timed = [m for m in measures if m in TIME]
    if timed:
        plain = [m for m in measures if m not in TIME]
        result = _over_time(wh, timed, by, where, fact, filters)
        if plain:
            result = _join_by(result, evaluate(wh, plain, by, where, fact, filters), by)
        return result.select(*by, *measures)

    base, derived = _needed(measures)
    rows_in = fact
    if rows_in is None:
        rows_in = wh.window_fact if LABELLED & set(base) else wh.window_charges
    if where is not None:
        rows_in = rows_in.filter(where)

    keys = list(dict.fromkeys(ATTRIBUTES[a] for a in [*by, *filters]))
    attributes = {key: [a for a in by if ATTRIBUTES[a] == key] for key in keys}
    growing = [key for key in keys if key in GROWING]
    for key in keys:
        if key not in GROWING:
            dimension = _dimension(wh, key, filters).select(key, *attributes[key])
            if key != "mcc":  # its size is the file's; the other keys have a fixed domain
                dimension = F.broadcast(dimension)
            rows_in = rows_in.join(dimension, key)
    fixed = [a for a in by if ATTRIBUTES[a] not in GROWING]

    kept = [DISTINCT[m][0] for m in measures if m in DISTINCT]
    result = rows_in.groupBy(*fixed, *dict.fromkeys([*growing, *kept])).agg(*[BASE[n]().alias(n) for n in base])
    if growing or kept:
        for key in growing:
            result = result.join(_dimension(wh, key, filters).select(key, *attributes[key]), key)
        aggs = [F.sum(n).alias(n) for n in base]
        for name in measures:
            if name in DISTINCT:
                key, count = DISTINCT[name]
                aggs.append(F.count_distinct(F.when(F.col(count) > 0, F.col(key))).alias(name))
        result = result.groupBy(*by).agg(*aggs)

    for name in derived:
        result = result.withColumn(name, DERIVED[name][1]())
    if any(m in PER_DAY for m in measures):
        result = _with_days(wh, result, by, filters)
        for name in measures:
            if name in PER_DAY:
                result = result.withColumn(name, ratio(F.col(PER_DAY[name]), F.col("_days")))
    return result.select(*by, *measures)


def _dimension(wh: CardWarehouse, key: str, filters: Mapping[str, Sequence[object]]) -> DataFrame:
    dimension = getattr(wh, _DIMENSION[key])
    for attribute, values in filters.items():
        if ATTRIBUTES[attribute] == key:
            dimension = dimension.filter(F.col(attribute).isin(*values))
    return dimension


def _join_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on all grouping columns; a missing label matches itself."""
    named = right.withColumnsRenamed({a: f"_{a}" for a in by})
    match = [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in by]
    return left.join(named, match, "left").drop(*[f"_{a}" for a in by])


def _over_time(
    wh: CardWarehouse, measures: Sequence[str], by: Sequence[str], where: Column | None, fact: DataFrame | None,
    filters: Mapping[str, Sequence[object]],
) -> DataFrame:
    """Time measures per group and period.

    The fact is reduced to the days per group that have any; every group gets the last day of every period besides, and all
    windows run inside a group, over ranges of days. A period stands where its last day does.
    """
    grains = [a for a in by if a in GRAINS]
    others = [a for a in by if ATTRIBUTES[a] != "date_key"]
    if len(grains) != 1 or len(grains) + len(others) != len(by):
        raise ValueError(f"time measures need one of {', '.join(GRAINS)} and no other date attribute in by")
    grain = grains[0]
    days = _days_and_ends(wh, evaluate(wh, _DAILY, [*others, "full_date"], where, fact, filters), others, grain)

    spend, day = "total_spend", "full_date"
    dated = days.withColumns({"_year": F.year(day), "_month": F.month(day)})
    days = dated.select(
        "*",
        periods.to_date(spend, day, [*others, "_year", "_month"]).alias("spend_mtd"),
        periods.to_date(spend, day, [*others, "_year"]).alias("spend_ytd"),
        periods.to_date(spend, day, others).alias("spend_running_total"),
        periods.trailing_range(spend, day, 30, others).alias("spend_rolling_30d"),
    )
    running = ["spend_mtd", "spend_ytd", "spend_running_total", "spend_rolling_30d"]
    start = F.trunc(day, GRAINS[grain]) if grain != "full_date" else F.col(day)
    per = days.groupBy(*others, start.alias("_start")).agg(
        *[F.sum(n).alias(n) for n in _DAILY], *[F.max_by(n, day).alias(n) for n in running]
    )
    rated = per.withColumn("failure_rate", DERIVED["failure_rate"][1]())
    both = periods.with_prior_year(rated, "_start", [spend, "failure_rate"], "_py", others)
    if grain == "year":
        both = both.withColumn("year", F.year("_start").cast(wh.dim_date.schema["year"].dataType))
    else:
        both = both.withColumn(grain, F.col("_start"))
    before = F.col("total_spend_py")
    made = {
        **{n: F.col(n) for n in running},
        "spend_rolling_30d_avg": ratio(F.col("spend_rolling_30d"), F.lit(30)),
        "spend_py": before,
        "spend_yoy": ratio(F.col(spend) - before, before),
        "failure_rate_py": F.col("failure_rate_py"),
        "failure_rate_yoy_pp": (F.col("failure_rate") - F.col("failure_rate_py")) * 100,
    }
    return both.select(*by, *[made[n].alias(n) for n in measures])


def _days_and_ends(wh: CardWarehouse, daily: DataFrame, others: Sequence[str], grain: str) -> DataFrame:
    """The days of each group that have facts, and with zeros the last day in the window of each period.

    Every other day of the calendar would only carry the sums of the day before.
    """
    last = wh.window_calendar.agg(F.max("full_date")).first()[0]
    first, until = F.to_date(F.lit(WINDOW_FIRST_DAY)), F.lit(last).cast("date")
    if last is None:
        ends = F.array().cast("array<date>")
    elif grain == "full_date":
        ends = F.sequence(first, until, F.expr("interval 1 day"))
    elif grain == "month_start":
        ends = F.transform(F.sequence(first, F.trunc(until, "month"), F.expr("interval 1 month")), lambda d: F.least(F.last_day(d), until))
    else:
        ends = F.transform(F.sequence(F.year(first), F.year(until)), lambda y: F.least(F.make_date(y, F.lit(12), F.lit(31)), until))
    groups = daily.select(*others).distinct() if others else wh.spark.range(1)
    zeros = [F.lit(0).cast(daily.schema[n].dataType).alias(n) for n in _DAILY]
    every = groups.select(*others, F.explode(ends).alias("full_date"), *zeros)
    known = daily.filter(F.col("full_date") <= until).select(*others, "full_date", *[F.coalesce(n, F.lit(0)).alias(n) for n in _DAILY])
    met = known.unionByName(every).groupBy(*others, "full_date").agg(*[F.sum(n).alias(n) for n in _DAILY])
    return met.withColumns({n: F.col(n).cast(daily.schema[n].dataType) for n in _DAILY})


def _with_days(
    wh: CardWarehouse, result: DataFrame, by: Sequence[str], filters: Mapping[str, Sequence[object]]
) -> DataFrame:
    """Adds the calendar days in context: those of the window that match the date attributes."""
    dates = [a for a in by if ATTRIBUTES[a] == "date_key"]
    days = wh.window_calendar
    for attribute, values in filters.items():
        if ATTRIBUTES[attribute] == "date_key":
            days = days.filter(F.col(attribute).isin(*values))
    days = days.groupBy(*dates).agg(rows().alias("_days"))
    if dates:
        return result.join(F.broadcast(days), dates)
    return result.withColumn("_one", F.lit(1)).join(
        F.broadcast(days.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")


# -- distinct counts that merge -----------------------------------------------


def stale_card_sets(wh: CardWarehouse, by: Sequence[str]) -> DataFrame:
    """The cards with stale credentials as bitmaps per combination of ``by``: a table to store once, from which
    ``cards_with_stale_credential`` counts any grouping by some of these attributes."""
    keys = list(dict.fromkeys(ATTRIBUTES[a] for a in by))
    uses = wh.window_charges.filter(has_any_error(*STALE_CREDENTIAL)).select(*dict.fromkeys([*keys, "card_id"])).distinct()
    for key in keys:
        uses = uses.join(_dimension(wh, key, {}).select(key, *[a for a in by if ATTRIBUTES[a] == key]), key)
    return key_sets(uses, by, "card_id")


def cards_with_stale_credential(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    return distinct_keys(sets, by, "cards_with_stale_credential")


# -- time intelligence --------------------------------------------------------


def daily_spend(wh: CardWarehouse) -> DataFrame:
    """Per day of the window: spend with its to-date, trailing and running forms."""
    days = periods.daily_totals(wh.window_calendar, wh.window_charges, {"total_spend": F.sum("amount")})
    rolling = periods.trailing_days("total_spend", "full_date", 30)
    return days.select(
        "full_date",
        "total_spend",
        periods.to_date("total_spend", "full_date", ["year", "month"]).alias("spend_mtd"),
        periods.to_date("total_spend", "full_date", ["year"]).alias("spend_ytd"),
        rolling.alias("spend_rolling_30d"),
        ratio(rolling, F.lit(30)).alias("spend_rolling_30d_avg"),
        periods.running_total("total_spend", "full_date").alias("spend_running_total"),
    )


def against_prior_year(wh: CardWarehouse, grain: str) -> DataFrame:
    """Spend and failure rate per year, month or day next to the same period a year earlier."""
    start = F.trunc("full_date", grain) if grain != "day" else F.col("full_date")
    totals = periods.daily_totals(
        wh.window_calendar,
        wh.window_charges,
        {"total_spend": F.sum("amount"), **{n: BASE[n]() for n in ("transactions", "failed_transactions")}},
    )
    per = totals.groupBy(start.alias("period_start")).agg(
        *[F.sum(c).alias(c) for c in ("total_spend", "transactions", "failed_transactions")]
    )
    rated = per.withColumn("failure_rate", ratio(F.col("failed_transactions"), F.col("transactions")))
    both = periods.with_prior_year(rated, "period_start", ["total_spend", "failure_rate"], "_py")
    spend, before = F.col("total_spend"), F.col("total_spend_py")
    return both.select(
        "period_start",
        "total_spend",
        F.col("total_spend_py").alias("spend_py"),
        ratio(spend - before, before).alias("spend_yoy"),
        "failure_rate",
        "failure_rate_py",
        ((F.col("failure_rate") - F.col("failure_rate_py")) * 100).alias("failure_rate_yoy_pp"),
    )
