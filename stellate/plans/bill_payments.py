"""Bill payments: staging, star schema, report view and the seven business questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.functions import calendar
from stellate.functions.literals import literal_table
from stellate.functions.rates import percent, rows, sum_where
from stellate.operators.gates import key_counters, row_total, side_by_side
from stellate.operators.numbering import with_dense_key
from stellate.operators.shares import with_share
from stellate.operators.star import split_by_dimensions
from stellate.session import cut_lineage
from stellate.sources.publish import Landing, Run, open_published, publish_layer

# The settled status and the days below which a month is partial.
SETTLED = "Sukses"
FULL_MONTH_DAYS = 28


def stage_bills(raw: DataFrame) -> DataFrame:
    """Typed bills; only the settled status counts as success."""
    day = F.col("tanggal").cast("date")
    status = F.trim("status")
    return raw.select(
        "id_transaksi",
        day.alias("transaction_date_clean"),
        F.month(day).alias("transaction_month"),
        F.year(day).alias("transaction_year"),
        "no_rekening",
        *[F.trim(c).alias(c) for c in ("nama_nasabah", "jenis_biller", "nama_biller")],
        "nomor_pelanggan",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("nominal", "biaya_admin", "total_bayar")],
        F.trim("channel").alias("channel"),
        status.alias("status"),
        F.when(status == SETTLED, 1).otherwise(0).cast("short").alias("is_success"),
    )


def staging_totals() -> dict[str, Column]:
    """Four counters that must be zero."""

    def empty(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    return {
        "null_dates": F.count_if(F.col("transaction_date_clean").isNull()),
        "null_channels": F.count_if(empty("channel")),
        "null_status": F.count_if(empty("status")),
        "amount_mismatch": F.count_if(F.col("total_bayar") != F.col("nominal") + F.col("biaya_admin")),
    }


def staging_gate(staged: DataFrame) -> DataFrame:
    """The counters over a frame; the job takes them while it writes."""
    return staged.agg(*[c.alias(name) for name, c in staging_totals().items()])


@dataclass
class BillWarehouse:
    spark: SparkSession
    raw: DataFrame
    staged: DataFrame
    #: Row counts known from manifests, by the names of ``load_check``.
    known: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_raw(cls, raw: DataFrame) -> BillWarehouse:
        return cls(raw.sparkSession, raw, stage_bills(raw))

    @cached_property
    def dim_date(self) -> DataFrame:
        """One pass over the bills; every later use reads the few days."""
        return cut_lineage(calendar.harvested_calendar(self.staged, "transaction_date_clean"))

    @cached_property
    def dim_channel(self) -> DataFrame:
        names = self.staged.select(F.col("channel").alias("channel_name")).distinct()
        return with_dense_key(names, "channel_key", ["channel_name"])

    @cached_property
    def dim_biller(self) -> DataFrame:
        names = self.staged.select("jenis_biller", "nama_biller").distinct()
        return with_dense_key(names, "biller_key", ["jenis_biller", "nama_biller"])

    @cached_property
    def fact(self) -> DataFrame:
        """Every staged row once, whether or not its dimensions have a key for it: the gates count those that have none."""
        s = self.staged.withColumn("channel_name", F.col("channel"))
        keyed = s.join(self.dim_channel, ["channel_name"], "left")
        keyed = keyed.join(self.dim_biller.select("biller_key", "nama_biller"), ["nama_biller"], "left")
        return keyed.select(
            F.col("id_transaksi").alias("transaction_id"),
            calendar.date_key(F.col("transaction_date_clean")).alias("date_key"),
            "channel_key",
            "biller_key",
            "no_rekening",
            "nomor_pelanggan",
            "nominal",
            "biaya_admin",
            "total_bayar",
            "status",
            "is_success",
        )

    @cached_property
    def report(self) -> DataFrame:
        return star_report(self.fact, self.dim_date, self.dim_channel, self.dim_biller)

    def load_check(self) -> DataFrame:
        """Rows at each step and in the report, which an inner join makes shorter by every row without a key."""
        steps = {"raw_rows": self.raw, "staged_rows": self.staged, "fact_rows": self.fact}
        counted = [
            literal_table(self.spark, [(self.known[name],)], f"{name} long") if name in self.known else row_total(frame, name)
            for name, frame in steps.items()
        ]
        return side_by_side(*counted, row_total(self.report, "report_rows"))

    def reference_gate(self) -> DataFrame:
        """Per dimension: facts without its key, and keys that it lacks. One scan and one shuffle of the facts' distinct keys."""
        dimensions = {"date_key": self.dim_date, "channel_key": self.dim_channel, "biller_key": self.dim_biller}
        pair = lambda key: F.struct(F.lit(key).alias("key"), F.col(key).cast("long").alias("value"))
        uses = self.fact.select(F.explode(F.array(*[pair(key) for key in dimensions])).alias("u")).groupBy("u.key", "u.value").agg(rows().alias("n"))
        members = reduce(DataFrame.unionByName, [d.select(pair(key).alias("u")).select("u.*") for key, d in dimensions.items()])
        met = uses.join(members.distinct().withColumn("there", F.lit(True)), ["key", "value"], "left")
        return met.groupBy("key").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("facts_without_key"),
            F.count_if(F.col("value").isNotNull() & F.col("there").isNull()).alias("missing"),
        )

    def key_gate(self) -> DataFrame:
        """Per table: keys that occur twice, and rows without one. A biller belongs to one kind."""
        found = None
        for name, table, key in (
            ("fact_transactions", self.fact, "transaction_id"), ("dim_date", self.dim_date, "date_key"),
            ("dim_channel", self.dim_channel, "channel_name"), ("dim_biller", self.dim_biller, "nama_biller"),
        ):
            one = key_counters(table, key).select(F.lit(name).alias("table_name"), "duplicate_keys", "null_keys")
            found = one if found is None else found.unionByName(one)
        return found

    def publish(self, root: str, check: Callable[[BillWarehouse], object] | None = None) -> dict[str, int]:
        """Write the warehouse; ``check`` sees the written tables before they become current."""

        def gate(read: Run) -> None:
            counts = {name: read.facts[t].rows for name, t in (("fact_rows", "fact_transactions"),)}
            written = BillWarehouse(self.spark, self.raw, self.staged, {**self.known, **counts})
            written.fact, written.dim_date = read("fact_transactions"), read("dim_date")
            written.dim_channel, written.dim_biller = read("dim_channel"), read("dim_biller")
            check(written)

        return publish_layer(
            self.spark,
            root,
            {
                "fact_transactions": Landing(self.fact),
                "dim_date": Landing(self.dim_date),
                "dim_channel": Landing(self.dim_channel),
                "dim_biller": Landing(self.dim_biller),
            },
            gate if check else None,
        )


def star_report(fact: DataFrame, dates: DataFrame, channels: DataFrame, billers: DataFrame) -> DataFrame:
    """The reporting view: fact with its three dimensions, revenue zeroed unless settled.

    Spark knows the sizes of the written dimensions and decides which to broadcast.
    """
    days = dates.select("date_key", "full_date", "day_name", "month", "month_name", "quarter", "year")
    joined = fact
    for dimension, key in ((days, "date_key"), (channels, "channel_key"), (billers, "biller_key")):
        joined = joined.join(dimension, key)
    return _report_columns(joined, F.col("is_success") == 1)


def report_from_tables(spark: SparkSession, root: str) -> DataFrame:
    tables = ("fact_transactions", "dim_date", "dim_channel", "dim_biller")
    read = open_published(spark, root)
    return star_report(*[read(name) for name in tables])


def _report_columns(joined: DataFrame, settled) -> DataFrame:
    return joined.select(
        "transaction_id", "full_date", "day_name", "month", "month_name", "quarter", "year",
        "channel_name", "jenis_biller", "nama_biller",
        "nominal", "biaya_admin", "total_bayar", "status", "is_success",
        F.when(settled, F.col("total_bayar")).otherwise(0).alias("gmv_settled"),
        F.when(settled, F.col("biaya_admin")).otherwise(0).alias("net_revenue"),
    )


def report_from_staging(staged: DataFrame) -> DataFrame:
    """The same 17 columns straight from staging.

    Every dimension attribute is a function of the staged row, so reports that
    read the view can skip the surrogate keys and the three joins.
    """
    day = F.col("full_date")
    settled = F.col("is_success") == 1
    wide = staged.withColumnsRenamed(
        {"id_transaksi": "transaction_id", "transaction_date_clean": "full_date", "channel": "channel_name"}
    ).withColumns(
        {
            "day_name": calendar.day_name(day),
            "month": F.month(day).cast("short"),
            "month_name": calendar.month_name(day),
            "quarter": F.quarter(day).cast("short"),
            "year": F.year(day).cast("short"),
        }
    )
    return _report_columns(wide, settled)


# -- business questions (over the report view) --------------------------------


def _success_rate():
    return percent(F.col("settled"), F.col("total_transactions"), 2).alias("success_rate_pct")


def _volumes() -> dict:
    return {
        "total_transactions": rows(),
        "settled": F.sum(F.col("is_success").cast("long")),
        "gmv": F.sum("gmv_settled"),
        "net_revenue": F.sum("net_revenue"),
    }


def _daily(report: DataFrame) -> DataFrame:
    """One row per day: what every calendar question starts from."""
    return report.groupBy("full_date").agg(*[c.alias(n) for n, c in _volumes().items()])


def _monthly(report: DataFrame) -> DataFrame:
    day = F.col("full_date")
    return (
        _daily(report)
        .groupBy(
            F.year(day).alias("year"), F.month(day).alias("month"), calendar.month_name(day).alias("month_name")
        )
        .agg(
            rows().alias("days_with_data"),
            *[F.sum(n).alias(n) for n in ("total_transactions", "settled", "gmv", "net_revenue")],
        )
    )


def volume_per_month(report: DataFrame) -> DataFrame:
    days, total = F.col("days_with_data"), F.col("total_transactions")
    return (
        _monthly(report)
        .select(
            "year", "month", "month_name", "total_transactions", "days_with_data",
            F.round(total.cast("decimal(20,0)") / days.cast("decimal(10,0)"), 0).cast("long").alias("avg_txn_per_day"),
            F.when(days < FULL_MONTH_DAYS, "PARTIAL MONTH").alias("data_note"),
        )
        .orderBy("year", "month")
    )


def revenue_per_month(report: DataFrame) -> DataFrame:
    """GMV is the customer's bill plus fee; the bank's own revenue is the fee."""
    return (
        _monthly(report)
        .orderBy("year", "month")
        .select(
            "year", "month_name", F.col("settled").alias("settled_transactions"), "gmv", "net_revenue",
            percent(F.col("net_revenue"), F.col("gmv"), 2).alias("take_rate_pct"),
        )
    )


def top_billers(report: DataFrame, k: int = 5) -> DataFrame:
    return (
        report.groupBy("nama_biller", "jenis_biller")
        .agg(*[c.alias(n) for n, c in _volumes().items()])
        .orderBy(F.desc("total_transactions"), "nama_biller", "jenis_biller")
        .limit(k)
        .select("nama_biller", "jenis_biller", "total_transactions", "net_revenue", _success_rate())
    )


def channel_breakdown(report: DataFrame) -> DataFrame:
    totals = report.groupBy("channel_name").agg(*[c.alias(n) for n, c in _volumes().items()])
    shares = with_share(totals, "total_transactions", "share_of_volume_pct", 2)
    shares = with_share(shares, "net_revenue", "share_of_revenue_pct", 2)
    return shares.select(
        "channel_name", "total_transactions", "share_of_volume_pct", "net_revenue", "share_of_revenue_pct", _success_rate()
    ).orderBy(F.desc("total_transactions"), "channel_name")


def status_split(report: DataFrame) -> DataFrame:
    totals = report.groupBy("status").agg(
        rows().alias("transactions"),
        F.sum("biaya_admin").alias("fees_at_stake"),
        F.coalesce(sum_where(F.col("biaya_admin"), F.col("is_success") == 0), F.lit(0)).alias("fees_forgone"),
    )
    return (
        with_share(totals, "transactions", "share_pct", 2)
        .select("status", "transactions", "share_pct", "fees_at_stake", "fees_forgone")
        .orderBy(F.desc("transactions"), "status")
    )


def success_by_dimension(report: DataFrame) -> DataFrame:
    """Channel, biller and weekday rates from one scan; weekdays are named after they are counted."""
    totals = split_by_dimensions(
        report,
        {"channel": F.col("channel_name"), "biller": F.col("nama_biller"), "weekday": calendar.iso_weekday(F.col("full_date"))},
        {"transactions": rows(), "settled": F.sum(F.col("is_success").cast("long"))},
    )
    segment = F.when(F.col("dimension") == "weekday", calendar.weekday_text(F.col("segment"))).otherwise(F.col("segment"))
    return totals.select(
        "dimension", segment.alias("segment"), "transactions",
        percent(F.col("settled"), F.col("transactions"), 2).alias("success_rate_pct"),
    ).orderBy("dimension", "success_rate_pct", "segment")


def daily_trend(report: DataFrame, before: str) -> DataFrame:
    """Days of complete months only: ``before`` is the first day that is left out."""
    return (
        _daily(report.filter(F.col("full_date") < F.to_date(F.lit(before))))
        .select("full_date", "total_transactions", F.col("settled").alias("settled_transactions"), "net_revenue")
        .orderBy("full_date")
    )
