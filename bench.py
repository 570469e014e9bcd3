"""Headline queries, timed end to end. Prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores. The card area runs the way it is used: ``card_build`` takes the raw text
through staging, label join, dimensions, fact and bridge to published tables,
and the card reports and measures read those. All other queries run from the
raw tables. Every query is planned anew for each run and its rows go to the
noop sink; the value is the sum of the best of BENCH_RUNS runs per query.
The jobs run once, from files and with all gates, the card job over at least
BENCH_CARD_ROWS transactions (default 1,330,000, a tenth of the baseline's).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

CARD_REPORTS = {
    "f3_1_1_leakage_by_year": "leakage_by_year",
    "f3_1_2_failures_by_error": "failures_by_error",
    "f3_1_5_failure_by_category": "failure_by_category",
    "f3_1_7_stale_declines_rollup": "stale_declines_by_category",
    "f3_1_7b_stale_rate_by_segment": "stale_rate_by_segment",
    "f3_2_1_label_coverage": "label_coverage",
    "f3_2_2_fraud_by_channel": "fraud_by_channel",
    "f3_2_5_loss_concentration": "loss_concentration",
    "f3_3_1_leakage_by_credit_band": "leakage_by_credit_band",
    "f3_3_4_by_brand_type_chip": "by_brand_type_chip",
    "f3_4_4_label_regime_by_year": "label_regime_by_year",
}
FROM_RAW = [
    "k11_fact",
    "s1_csv_scan_and_stage",
    "b2_q1_volume_per_month",
    "b2_q4_channel_breakdown",
    "b2_q6_success_by_dimension",
    "h3_a_hospital_access",
    "h3_b_state_summary",
    "c_1_monthly_growth",
    "c_5_top_by_revenue",
]


def write_card_files(spark, sf_dir: str, folder: str, least_rows: int) -> int:
    """The five card sources as files, the events repeated under new ids until there are ``least_rows``."""
    from pyspark.sql import functions as F

    from stellate.sources import driver_tables

    events = driver_tables.table(spark, sf_dir, "events")
    span, count = events.agg(F.max("event_id") + 1, F.count("*")).first()
    times = max(1, -(-least_rows // count))
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    repeated = events.withColumn("_copy", copies).withColumn("event_id", F.col("event_id") + F.col("_copy") * span)
    repeated.drop("_copy").write.parquet(f"{folder}/tables/events.parquet")

    def delimited(frame, name: str) -> None:
        frame.write.option("header", True).csv(f"{folder}/{name}")

    delimited(driver_tables.card_transactions(spark, f"{folder}/tables"), "transactions_data.csv")
    delimited(driver_tables.card_users(spark, sf_dir), "users_data.csv")
    delimited(driver_tables.card_cards_file(spark, sf_dir), "cards_data.csv")
    pair = F.concat(F.lit('"'), F.col("transaction_id"), F.lit('": "'), F.col("is_fraud"), F.lit('"'))
    labels = driver_tables.card_labels(spark, sf_dir).select(pair.alias("value"))
    labels.write.option("lineSep", ",").text(f"{folder}/train_fraud_labels.json")
    codes = driver_tables.card_mcc(spark, sf_dir)
    entry = F.concat(F.lit('"'), F.col("mcc"), F.lit('": "'), F.col("description"), F.lit('"'))
    whole = codes.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))
    whole.write.text(f"{folder}/mcc_codes.json")
    return count * times


def main() -> None:
    from checks.queries import QUERIES
    from pyspark.sql import functions as F

    from stellate.jobs import run_bills, run_card
    from stellate.plans import bill_payments, card_measures, card_reports
    from stellate.plans.card_warehouse import CardWarehouse, PublishedCardWarehouse
    from stellate.session import local_session, scratch_path
    from stellate.sources import driver_tables, schemas

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session("bench", cores=cores)
    seconds: dict[str, float] = {}

    def best_of(name: str, run) -> None:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)

    def once(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    def consume(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    root = scratch_path(spark, "bench")
    raw = CardWarehouse(spark, lambda name: driver_tables.card_source(spark, sf_dir, name))
    best_of("card_build", lambda: raw.publish(root))
    wh = PublishedCardWarehouse(spark, root)
    for name, report in CARD_REPORTS.items():
        best_of(name, lambda: consume(getattr(card_reports, report)(wh)))
    core = [m for m in card_measures.names() if m not in {*card_measures.DISTINCT, *card_measures.PER_DAY, *card_measures.TIME}]
    best_of("m1_m17_core_by_year", lambda: consume(card_measures.evaluate(wh, core, by=["year"])))
    best_of("m19_m27_daily_spend", lambda: consume(card_measures.daily_spend(wh)))
    for name in FROM_RAW:
        best_of(name, lambda: consume(QUERIES[name](spark, sf_dir)))

    # the jobs as users run them: files in, every gate, published layers out; the files are made before the clock starts
    files = scratch_path(spark, "bench_files")
    rows = write_card_files(spark, sf_dir, files, int(os.environ.get("BENCH_CARD_ROWS", "1330000")))
    once(f"card_job_{rows}_rows", lambda: run_card(spark, files, scratch_path(spark, "bench_card")))
    due = "coalesce(nominal, 0) + coalesce(biaya_admin, 0)"  # the test tables plant wrong totals, which the gate stops
    bills = driver_tables.bill_payments(spark, sf_dir).withColumn("total_bayar", F.expr(due))
    names = {column: source for source, column in schemas.BILLS_RENAMED.items()}
    bills.withColumnsRenamed(names).write.option("header", True).option("sep", ";").csv(f"{files}/bills")
    published = scratch_path(spark, "bench_bills")
    once("bill_job", lambda: run_bills(spark, f"{files}/bills", published))
    report = bill_payments.report_from_tables(spark, f"{published}/warehouse")
    for name in ("volume_per_month", "channel_breakdown", "success_by_dimension"):
        best_of(f"bills_published_{name}", lambda: consume(getattr(bill_payments, name)(report)))

    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
                "runs": runs,
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
