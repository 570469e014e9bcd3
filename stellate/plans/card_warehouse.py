"""Card transactions: typed staging, star schema, bridge and reporting window."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.functions import bands, calendar, text
from stellate.functions.literals import literal_map, literal_table
from stellate.operators.gates import key_counters, missing_counts, side_by_side
from stellate.operators.numbering import hash_key
from stellate.sources.publish import Landing, Reader, buckets_for, open_published, publish_layer, register_views, totals_of

# Calendar span and first day of the reporting window.
CALENDAR_FIRST, CALENDAR_LAST = "2010-01-01", "2019-12-31"
WINDOW_FIRST_KEY, WINDOW_FIRST_DAY = 20170101, "2017-01-01"

# Folder column of the published fact.
YEAR_FOLDER = "fact_year"

# Channels (key, name, card present).
CHANNELS = [(1, "Chip", True), (2, "Swipe", True), (3, "Online", False)]

# Decline reasons (key, name, who can fix it).
ERRORS = [
    (1, "Insufficient Balance", "Customer"),
    (2, "Bad PIN", "Customer"),
    (3, "Technical Glitch", "Issuer"),
    (4, "Bad Expiration", "Issuer"),
    (5, "Bad Card Number", "Data entry"),
    (6, "Bad CVV", "Data entry"),
    (7, "Bad Zipcode", "Data entry"),
]
STALE_CREDENTIAL = ("Bad Card Number", "Bad CVV", "Bad Expiration")

# Merchant category codes per spend category. Listed codes win over the range.
SPEND_CATEGORIES = {
    "Groceries & Food Retail": [5411, 5499, 5300, 5921],
    "Restaurants & Bars": [5812, 5813, 5814],
    "Fuel & Automotive": [5541, 5533, 7531, 7538, 7542, 7549],
    "Transport & Travel": [
        3722, 3730, 3771, 3775, 4111, 4112, 4121, 4131, 4214, 4411, 4511, 4722, 4784, 7011,
    ],
    "Utilities & Telecom": [4814, 4899, 4900, 3780],
    "Digital & Entertainment": [5815, 5816, 7801, 7802, 7832, 7922, 7995, 7996],
    "Health & Personal Care": [5912, 7210, 7230, 8011, 8021, 8041, 8043, 8049, 8062, 8099],
    "Financial & Professional Services": [4829, 6300, 7276, 7393, 8111, 8931, 9402],
    "Home & Trade Supplies": [1711, 3504, 3509, 3596, 3640, 3684, 5211, 5251, 5261, 7349],
}
MANUFACTURING_RANGE, MANUFACTURING_CATEGORY = (3000, 3999), "Home & Trade Supplies"
OTHER_CATEGORY = "General Retail & Apparel"


def spend_category(mcc: Column) -> Column:
    listed = literal_map((code, name) for name, codes in SPEND_CATEGORIES.items() for code in codes)
    ranged = F.when(mcc.between(*MANUFACTURING_RANGE), MANUFACTURING_CATEGORY)
    return F.coalesce(F.try_element_at(listed, mcc), ranged, F.lit(OTHER_CATEGORY))


# -- staging ------------------------------------------------------------------


def type_transactions(raw: DataFrame) -> DataFrame:
    """Typed transactions. The channel decides what is online, not the city text."""
    at = F.col("date").cast("timestamp_ntz")
    return raw.select(
        F.col("id").cast("long").alias("transaction_id"),
        at.alias("transacted_at"),
        at.cast("date").alias("transaction_date"),
        F.hour(at).cast("short").alias("hour_of_day"),
        F.col("client_id").cast("int").alias("client_id"),
        F.col("card_id").cast("int").alias("card_id"),
        text.money(F.col("amount")).alias("amount"),
        F.col("use_chip").alias("channel"),
        F.col("merchant_id").cast("int").alias("merchant_id"),
        "merchant_city",
        "merchant_state",
        text.whole_number(F.col("zip")).alias("zip"),
        F.col("mcc").cast("int").alias("mcc"),
        text.comma_list(F.col("errors")).alias("error_list"),
        F.col("errors").isNotNull().alias("is_failed"),
        (F.col("use_chip") == "Online Transaction").alias("is_online"),
    )


def type_labels(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("transaction_id").cast("long").alias("transaction_id"), "is_fraud")


def attach_labels(typed: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the fraud label where one exists; without one, ``is_fraud`` is unknown.

    The one large shuffle of the flow: both ids are unique, so no key is hot. Staged tables lie in buckets of the
    id, so that labels which come later join them where they lie.
    """
    known = type_labels(labels).withColumnRenamed("is_fraud", "_label")
    return typed.join(known, "transaction_id", "left").select(
        *typed.columns,
        F.col("_label").isNotNull().alias("has_fraud_label"),
        (F.col("_label") == "Yes").alias("is_fraud"),
    )


def stage_clients(raw: DataFrame) -> DataFrame:
    debt = text.money(F.col("total_debt"), "decimal(18,6)")
    income = text.money(F.col("yearly_income"), "decimal(18,6)")
    return raw.select(
        F.col("id").cast("int").alias("client_id"),
        F.col("current_age").cast("short").alias("current_age"),
        F.col("retirement_age").cast("short").alias("retirement_age"),
        "gender",
        F.col("latitude").cast("decimal(9,4)").alias("latitude"),
        F.col("longitude").cast("decimal(9,4)").alias("longitude"),
        *[text.money(F.col(c), "int").alias(c) for c in ("per_capita_income", "yearly_income", "total_debt")],
        F.col("credit_score").cast("short").alias("credit_score"),
        F.col("num_credit_cards").cast("short").alias("num_credit_cards"),
        F.round(F.try_divide(debt, income), 3).cast("decimal(18,3)").alias("debt_to_income"),
    )


def stage_cards(raw: DataFrame) -> DataFrame:
    """The dark-web flag is constant in the source and goes no further."""
    return raw.select(
        F.col("id").cast("int").alias("card_id"),
        F.col("client_id").cast("int").alias("client_id"),
        "card_brand",
        "card_type",
        text.month_year(F.col("expires")).alias("expires_on"),
        text.month_year(F.col("acct_open_date")).alias("account_opened_on"),
        (F.col("has_chip") == "YES").alias("has_chip"),
        F.col("num_cards_issued").cast("short").alias("num_cards_issued"),
        text.money(F.col("credit_limit"), "int").alias("credit_limit"),
    )


# -- dimensions ---------------------------------------------------------------


def channel_dimension(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CHANNELS, "channel_key short, channel_name string, is_card_present boolean")


def error_dimension(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ERRORS, "error_key short, error_name string, fault_owner string")


def ticket_band_dimension(spark: SparkSession) -> DataFrame:
    return bands.TICKET.as_table(spark, "ticket_band")


def client_dimension(clients: DataFrame) -> DataFrame:
    banded = {
        "age_band": (bands.AGE, "current_age"),
        "credit_band": (bands.CREDIT, "credit_score"),
        "income_band": (bands.INCOME, "yearly_income"),
        "dti_band": (bands.DEBT_TO_INCOME, "debt_to_income"),
    }
    labelled = [
        col
        for name, (scale, source) in banded.items()
        for col in (scale.label(F.col(source)).alias(name), scale.order(F.col(source)).alias(f"{name}_order"))
    ]
    return clients.select(
        "client_id", "current_age", "gender", "credit_score", "yearly_income", "total_debt",
        "debt_to_income", "num_credit_cards", "latitude", "longitude", *labelled,
    )


def card_dimension(cards: DataFrame) -> DataFrame:
    limit = F.col("credit_limit")
    return cards.select(
        "card_id", "client_id", "card_brand", "card_type", "has_chip", "credit_limit",
        "account_opened_on", "expires_on", "num_cards_issued",
        bands.CREDIT_LIMIT.label(limit).alias("limit_band"),
        bands.CREDIT_LIMIT.order(limit).alias("limit_band_order"),
    )


def mcc_dimension(raw: DataFrame) -> DataFrame:
    mcc = F.col("mcc").cast("int")
    return raw.select(mcc.alias("mcc"), "description", spend_category(mcc).alias("spend_category"))


# A place without a state or zip still has a key: the gaps get these sentinels.
_NO_STATE, _NO_ZIP = "", -1


def _place() -> dict[str, Column]:
    return {
        "city": F.col("merchant_city"),
        "state": F.coalesce("merchant_state", F.lit(_NO_STATE)),
        "zip": F.coalesce("zip", F.lit(_NO_ZIP)),
    }


def location_key() -> Column:
    """Key of a transaction's place, computed from the place itself."""
    place = _place()
    return F.when(F.col("merchant_city").isNotNull(), hash_key(*place.values()))


def location_dimension(transactions: DataFrame) -> DataFrame:
    """One row per (city, state, zip). A two-letter state means domestic; online has no country."""
    place = _place()
    places = (
        transactions.filter(F.col("merchant_city").isNotNull())
        .groupBy(*[c.alias(name) for name, c in place.items()])
        .agg(F.min(location_key()).alias("location_key"))
    )
    online = F.col("city") == "ONLINE"
    state = F.nullif(F.col("state"), F.lit(_NO_STATE))
    domestic = F.length(state) == 2
    return places.select(
        "location_key",
        "city",
        "state",
        F.when(online, None)
        .when(domestic, F.lit("United States"))
        .otherwise(state)
        .cast("string")
        .alias("country"),
        F.when(~online, domestic).alias("is_domestic"),
        "zip",
        online.alias("is_online"),
    )


# -- fact and bridge ----------------------------------------------------------


def _lookup(pairs: list[tuple], value: Column) -> Column:
    """Key of a fixed, literal dimension as a map lookup inside the projection."""
    return F.try_element_at(literal_map((name, key) for key, name, *_ in pairs), value).cast("short")


def reason_text(error_list: Column) -> Column:
    """The items of a decline list, trimmed and fenced by commas: ',Bad PIN,Bad CVV,'."""
    joined = F.regexp_replace(F.trim(F.array_join(error_list, ",")), " *, *", ",")
    return F.concat(F.lit(","), joined, F.lit(","))


def error_keys(reasons: Column) -> Column:
    """Known decline reasons of one transaction, each once; unknown names have no key.

    Takes the text of ``reason_text`` as a column of its own, so that it is
    made once per row, and looks for the few fixed names without lambdas.
    """
    present = F.array(
        *[F.when(F.contains(reasons, F.lit(f",{name},")), key).otherwise(0).cast("short") for key, name, _ in ERRORS]
    )
    none = F.array().cast("array<smallint>")
    return F.when(reasons.isNotNull(), F.array_remove(present, F.lit(0).cast("short"))).otherwise(none)


def assemble_fact(transactions: DataFrame) -> DataFrame:
    """One row per transaction. No join: every key is computed from the row.

    A value without a key keeps its row and gets a NULL key, so that the gates
    can count it. ``error_keys`` carries the bridge, so that reports which need
    the decline reasons explode it instead of joining on the transaction id.
    """
    amount = F.col("amount")
    labels = [
        F.col("has_fraud_label"),
        F.coalesce("is_fraud", F.lit(False)).alias("is_fraud"),
    ]
    return transactions.withColumn("_reasons", reason_text(F.col("error_list"))).select(
        "transaction_id",
        calendar.date_key(F.col("transaction_date")).alias("date_key"),
        "hour_of_day",
        "client_id",
        "card_id",
        "merchant_id",
        location_key().alias("location_key"),
        "mcc",
        _lookup(CHANNELS, text.first_word(F.col("channel"))).alias("channel_key"),
        bands.TICKET.key(F.abs(amount)).alias("ticket_band_key"),
        "amount",
        F.abs(amount).alias("abs_amount"),
        (amount < 0).alias("is_refund"),
        (amount == 0).alias("is_zero_auth"),
        "is_failed",
        "is_online",
        *(labels if "has_fraud_label" in transactions.columns else []),
        error_keys(F.col("_reasons")).alias("error_keys"),
    )


def bridge_of(fact: DataFrame, *carried: str) -> DataFrame:
    """(transaction_id, error_key) rows, with fact columns carried along instead of joined back.

    Only failed transactions have reasons. The outer explode keeps Spark from
    adding a size filter that would compute the keys a second time.
    """
    return (
        fact.filter("is_failed")
        .select("transaction_id", *carried, F.explode_outer("error_keys").alias("error_key"))
        .filter(F.col("error_key").isNotNull())
    )


def has_any_error(*names: str) -> Column:
    """True once per transaction, however many of the named reasons it has."""
    wanted = [F.lit(key).cast("short") for key, name, _ in ERRORS if name in names]
    return F.coalesce(F.arrays_overlap("error_keys", F.array(*wanted)), F.lit(False))


def _names_unknown(names: Column) -> Column:
    return F.size(F.filter(names, lambda name: _lookup(ERRORS, F.trim(name)).isNull()))


#: Per table what is counted and summed over its rows, while they are written or, over lazy frames, in one pass.
TOTALS: dict[str, dict[str, Callable[[], Column]]] = {
    "transactions": {
        "null_dates": lambda: F.count_if(F.col("transacted_at").isNull()),
        "null_amounts": lambda: F.count_if(F.col("amount").isNull()),
        "null_mcc": lambda: F.count_if(F.col("mcc").isNull()),
        "failed_without_error": lambda: F.count_if(F.col("is_failed") & F.col("error_list").isNull()),
        "channel_disagreement": lambda: F.count_if(F.col("is_online") != (F.col("merchant_city") == "ONLINE")),
        "unknown_errors": lambda: F.coalesce(F.sum(_names_unknown(F.col("error_list"))), F.lit(0)),
        "staged": lambda: F.count(F.lit(1)),
        "staged_amount": lambda: F.sum("amount"),
    },
    "fact_transaction": {
        "facts": lambda: F.count(F.lit(1)),
        "fact_amount": lambda: F.sum("amount"),
        "unmatched_channel": lambda: F.count_if(F.col("channel_key").isNull()),
        "unmatched_location": lambda: F.count_if(F.col("location_key").isNull()),
        "unbanded_ticket": lambda: F.count_if(F.col("ticket_band_key").isNull()),
        "bi_window_rows": lambda: F.count_if(F.col("date_key") >= WINDOW_FIRST_KEY),
        "bridge_rows": lambda: F.sum(F.coalesce(F.size("error_keys"), F.lit(0))),
        "fraud_rows": lambda: F.count_if("is_fraud"),
        "zero_auth_rows": lambda: F.count_if("is_zero_auth"),
    },
    "dim_mcc": {"uncategorised_mcc": lambda: F.count_if(F.col("spend_category").isNull())},
    "dim_location": {"locations": lambda: F.count(F.lit(1))},
}


def totals_columns(table: str) -> dict[str, Column]:
    return {name: make() for name, make in TOTALS.get(table, {}).items()}


class CardWarehouse:
    """The card star schema as lazy frames over raw text.

    ``source(name)`` gives a raw source: transactions, users, cards, mcc or
    fraud_labels. ``charges`` is the fact without its two label columns:
    reports that ask nothing about fraud read it and spare the label join.
    """

    def __init__(self, spark: SparkSession, source: Callable[[str], DataFrame]):
        self.spark = spark
        self._source = source
        self._runs: list[Callable[[str], DataFrame]] = [source]

    @cached_property
    def typed(self) -> DataFrame:
        return type_transactions(self._source("transactions"))

    @cached_property
    def transactions(self) -> DataFrame:
        return attach_labels(self.typed, self.labels)

    @cached_property
    def labels(self) -> DataFrame:
        return self._source("fraud_labels")

    @cached_property
    def clients(self) -> DataFrame:
        return stage_clients(self._source("users"))

    @cached_property
    def cards(self) -> DataFrame:
        return stage_cards(self._source("cards"))

    @cached_property
    def mcc_codes(self) -> DataFrame:
        return self._source("mcc")

    @cached_property
    def charges(self) -> DataFrame:
        return assemble_fact(self.typed)

    @cached_property
    def fact(self) -> DataFrame:
        return assemble_fact(self.transactions)

    @cached_property
    def dim_date(self) -> DataFrame:
        return F.broadcast(calendar.generated_calendar(self.spark, CALENDAR_FIRST, CALENDAR_LAST))

    @cached_property
    def dim_channel(self) -> DataFrame:
        return F.broadcast(channel_dimension(self.spark))

    @cached_property
    def dim_error(self) -> DataFrame:
        return F.broadcast(error_dimension(self.spark))

    @cached_property
    def dim_ticket_band(self) -> DataFrame:
        return F.broadcast(ticket_band_dimension(self.spark))

    @cached_property
    def dim_mcc(self) -> DataFrame:
        """Codes have four digits: at most 10,000 rows."""
        return F.broadcast(mcc_dimension(self.mcc_codes))

    @cached_property
    def dim_client(self) -> DataFrame:
        return client_dimension(self.clients)

    @cached_property
    def dim_card(self) -> DataFrame:
        return card_dimension(self.cards)

    @cached_property
    def dim_location(self) -> DataFrame:
        return location_dimension(self.typed)

    @cached_property
    def bridge(self) -> DataFrame:
        return bridge_of(self.charges)

    # -- reporting window

    @cached_property
    def window_fact(self) -> DataFrame:
        return self.fact.filter(F.col("date_key") >= WINDOW_FIRST_KEY)

    @cached_property
    def window_charges(self) -> DataFrame:
        return self.charges.filter(F.col("date_key") >= WINDOW_FIRST_KEY)

    @cached_property
    def window_bridge(self) -> DataFrame:
        return bridge_of(self.window_charges)

    @cached_property
    def window_calendar(self) -> DataFrame:
        """The calendar from the window's first day to the last fact, read from the facts."""
        last = self.charges.agg(F.max("date_key")).scalar()
        return self.dim_date.filter(
            (F.col("full_date") >= F.to_date(F.lit(WINDOW_FIRST_DAY))) & (F.col("date_key") <= last)
        )

    def totals(self, table: str) -> DataFrame:
        """One row with the table's TOTALS: from the manifest of the run it was written in, else over the frame itself."""
        for read in self._runs:
            held = totals_of(read, table)
            if held is not None:
                return held
        frame = {"transactions": "typed", "fact_transaction": "fact"}.get(table, table)
        return getattr(self, frame).agg(*[c.alias(n) for n, c in totals_columns(table).items()])

    def views(self) -> dict[str, DataFrame]:
        return {
            "fact_transaction": self.window_fact,
            "br_transaction_error": self.window_bridge,
            "dim_date": self.window_calendar,
            "dim_client": self.dim_client,
            "dim_card": self.dim_card,
            "dim_location": self.dim_location,
            "dim_mcc": self.dim_mcc,
            "dim_channel": self.dim_channel,
            "dim_ticket_band": self.dim_ticket_band,
            "dim_error": self.dim_error,
        }

    def register_views(self) -> None:
        register_views(self.views(), "bi")

    def publish_staging(self, root: str, check: Callable[[CardWarehouse], object] | None = None) -> dict[str, int]:
        """Write the typed tables: the only place where raw transactions are read and labels are joined.

        Transactions and labels are dealt into buckets of the transaction id: later joins on it and the gate on its
        uniqueness need no shuffle. ``check`` sees a warehouse over the written tables before they become current.
        """
        raw = getattr(self._source, "facts", {}).get("transactions")
        n = buckets_for(raw.rows if raw else 0)
        ids = {"bucket_by": "transaction_id", "buckets": n}
        tables = {
            "fraud_labels": Landing(type_labels(self.labels), **ids),
            "transactions": Landing(
                # the join's own shuffle deals the transactions; the labels lie dealt already
                lambda written: attach_labels(self.typed.repartition(n, "transaction_id"), written("fraud_labels")),
                totals=totals_columns("transactions"), dealt=True, **ids,
            ),
            "clients": Landing(self.clients),
            "cards": Landing(self.cards),
            "mcc": Landing(self.mcc_codes),
        }
        gate = (lambda read: check(StagedCardWarehouse(self.spark, read))) if check else None
        return publish_layer(self.spark, root, tables, gate)

    def publish(self, root: str, check: Callable[[CardWarehouse], object] | None = None) -> dict[str, int]:
        """Write the warehouse; the fact is laid out by year, so that the window prunes folders, and in ranges of days inside a
        year, so that a month or a day prunes files and row groups by their statistics.

        The bridge is read off the written fact, and ``check`` sees the written warehouse
        next to this one's staging before it becomes current.
        """
        by_year = self.fact.withColumn(YEAR_FOLDER, F.floor(F.col("date_key") / 10000).cast("int"))
        gate = (lambda read: check(PublishedCardWarehouse(self.spark, read, staged=self))) if check else None
        return publish_layer(
            self.spark,
            root,
            {
                "fact_transaction": Landing(
                    by_year, partition_by=(YEAR_FOLDER,), order_by=("date_key", "transaction_id"),
                    totals=totals_columns("fact_transaction"), extremes=("date_key",),
                ),
                "br_transaction_error": Landing(lambda written: bridge_of(written("fact_transaction"))),
                "dim_date": Landing(self.dim_date),
                "dim_client": Landing(self.dim_client),
                "dim_card": Landing(self.dim_card),
                "dim_location": Landing(self.dim_location, totals=totals_columns("dim_location")),
                "dim_mcc": Landing(self.dim_mcc, totals=totals_columns("dim_mcc")),
                "dim_channel": Landing(self.dim_channel),
                "dim_ticket_band": Landing(self.dim_ticket_band),
                "dim_error": Landing(self.dim_error),
            },
            gate,
        )


class StagedCardWarehouse(CardWarehouse):
    """The star schema over written staging tables; ``read(name)`` gives one of them."""

    def __init__(self, spark: SparkSession, read: Reader):
        super().__init__(spark, read)
        self.typed = self.transactions = read("transactions")
        self.clients, self.cards, self.mcc_codes = read("clients"), read("cards"), read("mcc")


class PublishedCardWarehouse(CardWarehouse):
    """The same star schema over published tables: reports scan the columns and years they need.

    ``source`` is the layer's folder, whose current run is looked up once, or a reader of
    one run. Dimension sizes are known from their files, so Spark decides which to broadcast.
    """

    def __init__(self, spark: SparkSession, source: str | Reader, staged: CardWarehouse | None = None):
        read = open_published(spark, source) if isinstance(source, str) else source
        super().__init__(spark, read)
        for name in ("dim_date", "dim_channel", "dim_error", "dim_ticket_band", "dim_mcc", "dim_client",
                     "dim_card", "dim_location"):
            setattr(self, name, read(name))
        self.charges = self.fact = read("fact_transaction")
        if staged is not None:
            self.typed = staged.typed
            self._runs += staged._runs

    @cached_property
    def window_calendar(self) -> DataFrame:
        """The calendar up to the last fact, which the manifest names."""
        known = getattr(self._source, "facts", {}).get("fact_transaction")
        if known is None or "date_key" not in known.greatest:
            return super().window_calendar
        last = known.greatest["date_key"]
        days = self.dim_date.filter(F.col("full_date") >= F.to_date(F.lit(WINDOW_FIRST_DAY)))
        return days.filter(F.col("date_key") <= F.lit(last).cast("int"))

    @cached_property
    def window_fact(self) -> DataFrame:
        first_year = WINDOW_FIRST_KEY // 10000
        return self.fact.filter((F.col(YEAR_FOLDER) >= first_year) & (F.col("date_key") >= WINDOW_FIRST_KEY))

    @cached_property
    def window_charges(self) -> DataFrame:
        return self.window_fact

    @cached_property
    def bridge(self) -> DataFrame:
        return self._source("br_transaction_error")


# -- gates --------------------------------------------------------------------


def staging_gate(wh: CardWarehouse) -> DataFrame:
    """Seven counters that must be zero: four were taken while the table was written, three need one scan of its keys."""
    direct = wh.totals("transactions").select("null_dates", "null_amounts", "null_mcc", "failed_without_error")
    keys = ("card_id", "client_id", "mcc")
    uses = wh.typed.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("key")) for k in keys])).alias("u"))
    known = None
    for key, table in zip(keys, (wh.cards, wh.clients, wh.mcc_codes), strict=True):
        one = table.select(F.lit(key).alias("kind"), F.col(key).cast("long").alias("key"))
        known = one if known is None else known.unionByName(one)
    names = {"card_id": "orphan_cards", "client_id": "orphan_clients", "mcc": "unknown_mcc"}
    return side_by_side(direct, missing_counts(uses.select("u.kind", "u.key"), known, names))


def channel_disagreement(wh: CardWarehouse) -> DataFrame:
    """Informational: rows whose city text contradicts their channel."""
    return wh.totals("transactions").select(F.col("channel_disagreement").cast("long").alias("informational_channel_disagreement"))


def reconciliation_gate(wh: CardWarehouse) -> DataFrame:
    """Source against warehouse. Every counter must be zero.

    What can be told from single rows was counted while they were written; the days and the places are one scan each.
    """
    both = side_by_side(
        wh.totals("transactions").select("staged", "staged_amount", "unknown_errors"),
        wh.totals("fact_transaction").select("facts", "fact_amount", "unmatched_channel", "unmatched_location", "unbanded_ticket"),
        wh.totals("dim_mcc").select("uncategorised_mcc"),
    ).select(
        (F.col("staged") - F.col("facts")).alias("rows_lost"),
        (F.col("staged_amount") - F.col("fact_amount")).alias("amount_drift"),
        "uncategorised_mcc", "unmatched_channel", "unmatched_location", "unbanded_ticket", "unknown_errors",
    )
    return side_by_side(both, _days_compared(wh), wrong_location(wh))


def _days_compared(wh: CardWarehouse) -> DataFrame:
    """Rows on days that the calendar lacks, and days of the reporting window without a row."""
    per_day = wh.charges.groupBy(F.col("date_key").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    window = wh.window_calendar.select(F.col("date_key").alias("inside"))
    days = wh.dim_date.select("date_key").join(window, F.col("date_key") == F.col("inside"), "left")
    met = days.join(per_day, F.col("date_key") == F.col("day"), "full_outer")
    return met.agg(
        F.coalesce(F.sum(F.when(F.col("date_key").isNull(), F.col("n"))), F.lit(0)).alias("unmatched_date"),
        F.count_if(F.col("inside").isNotNull() & F.col("n").isNull()).alias("empty_bi_days"),
    )


# Counters of the reconciliation that are reported without failing the layer: a name
# that is in no list of reasons is dropped from the bridge, as it is in the source model.
INFORMATIONAL = ("unknown_errors",)


# Tables and their keys, none of which may be missing or occur twice.
KEYS = {
    "fact_transaction": ("fact", ("transaction_id",)),
    "br_transaction_error": ("bridge", ("transaction_id", "error_key")),
    "dim_client": ("dim_client", ("client_id",)),
    "dim_card": ("dim_card", ("card_id",)),
    "dim_location": ("dim_location", ("location_key",)),
    "dim_mcc": ("dim_mcc", ("mcc",)),
}


def key_gate(wh: CardWarehouse) -> DataFrame:
    """Per table how many keys occur twice, how many rows have none, and how many are outside their domain.

    Category codes have four digits, which bounds their dimension.
    """
    found = None
    for table, (name, key) in KEYS.items():
        frame = getattr(wh, name)
        one = key_counters(frame, *key).select(F.lit(table).alias("table_name"), "duplicate_keys", "null_keys")
        found = one if found is None else found.unionByName(one)
    beyond = wh.dim_mcc.filter(~F.col("mcc").between(0, 9999)).agg(F.count(F.lit(1)).alias("n"))
    codes = beyond.select(F.lit("dim_mcc, codes beyond four digits").alias("table_name"), F.col("n").alias("duplicate_keys"), F.lit(0).cast("long").alias("null_keys"))
    return found.unionByName(codes)


def id_gate(wh: CardWarehouse) -> DataFrame:
    """Staged transactions and labels by id, where they lie: buckets are grouped without a shuffle."""
    staged = key_counters(wh.transactions.select("transaction_id"), "transaction_id")
    labels = key_counters(type_labels(wh.labels).select("transaction_id"), "transaction_id")
    named = [t.select(F.lit(n).alias("table_name"), "duplicate_keys", "null_keys") for n, t in (("transactions", staged), ("fraud_labels", labels))]
    return named[0].unionByName(named[1])


def wrong_location(wh: CardWarehouse) -> DataFrame:
    """Facts whose location row differs from their source row in city, state or zip.

    Compared per distinct (key, place): the transactions are reduced to their
    places before they meet the dimension.
    """
    t = wh.typed
    place = _place()
    used = t.groupBy(location_key().alias("location_key"), *[c.alias(f"src_{n}") for n, c in place.items()]).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = used.join(wh.dim_location, "location_key", "left")
    differs = None
    for name in place:
        part = ~F.col(name).eqNullSafe(F.col(f"src_{name}"))
        differs = part if differs is None else differs | part
    return joined.agg(F.coalesce(F.sum(F.when(differs, F.col("n"))), F.lit(0)).alias("wrong_location"))


def sizes(wh: CardWarehouse) -> DataFrame:
    """Informational sizes."""
    return side_by_side(
        wh.totals("fact_transaction").select("bi_window_rows", "bridge_rows", "fraud_rows", "zero_auth_rows"),
        wh.totals("dim_location").select("locations"),
    )
