"""End-to-end jobs: files in, gated and published layers out.

    spark-submit -m stellate.jobs card  <source folder> <output folder>
    spark-submit -m stellate.jobs bills <source file>   <output folder>
    spark-submit -m stellate.jobs trauma <source file>  <output folder>

Each layer is written to a new run folder, checked, and only then becomes the
current one. Running a job again replaces the layers.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from stellate.operators.gates import enforce, enforce_rows
from stellate.plans import bill_payments, card_warehouse, trauma_access
from stellate.plans.card_warehouse import CardWarehouse, PublishedCardWarehouse, StagedCardWarehouse
from stellate.sources import readers, schemas
from stellate.sources.publish import Landing, Reader, export_csv, open_published, publish_layer, read_published, totals_of


log = logging.getLogger(__name__)


def _report(name: str, result: DataFrame) -> None:
    """Informational counters: written to the log, never a reason to stop. Beyond 100 rows the log says so."""
    rows = result.limit(101).collect()
    for row in rows[:100]:
        log.info("%s: %s", name, row.asDict())
    if len(rows) > 100:
        log.info("%s: more rows than the 100 logged", name)


def land_card_sources(
    spark: SparkSession, folder: str, root: str, expected: Mapping[str, int] | None = None, line_breaks: bool = True
) -> dict[str, int]:
    """All five card sources as text tables. The label object is parsed here, once.

    Quoted fields may hold line breaks; without ``line_breaks`` that stops the load, and the scan that looks for them is spared.
    """
    expected = expected or {}
    delimited = partial(readers.read_delimited, spark, line_breaks=line_breaks)
    # Names of the source files.
    frames = {
        "transactions": delimited(f"{folder}/transactions_data.csv", schemas.TRANSACTIONS),
        "users": delimited(f"{folder}/users_data.csv", schemas.USERS),
        "cards": readers.read_card_file(spark, f"{folder}/cards_data.csv"),
        "mcc": readers.read_code_map(spark, f"{folder}/mcc_codes.json"),
        "fraud_labels": readers.read_label_object(spark, f"{folder}/train_fraud_labels.json"),
    }
    return publish_layer(
        spark, root, {name: Landing(frame, expected.get(name)) for name, frame in frames.items()}
    )


def run_card(
    spark: SparkSession, folder: str, out: str, expected: Mapping[str, int] | None = None
) -> PublishedCardWarehouse:
    """Land, stage once, gate the written staging, model from it, gate the written warehouse, publish.

    Raw transactions are read and labels joined for the staging tables only.
    """
    land_card_sources(spark, folder, f"{out}/raw", expected)

    def staging(wh: CardWarehouse) -> None:
        enforce("card staging", card_warehouse.staging_gate(wh))
        enforce_rows("card ids", card_warehouse.id_gate(wh), "table_name")
        _report("channel disagreement", card_warehouse.channel_disagreement(wh))

    def model(wh: CardWarehouse) -> None:
        enforce_rows("card keys", card_warehouse.key_gate(wh), "table_name")
        enforce(
            "card reconciliation",
            card_warehouse.reconciliation_gate(wh),
            informational=card_warehouse.INFORMATIONAL,
        )
        _report("sizes", card_warehouse.sizes(wh))

    CardWarehouse(spark, open_published(spark, f"{out}/raw")).publish_staging(f"{out}/staging", staging)
    StagedCardWarehouse(spark, open_published(spark, f"{out}/staging")).publish(f"{out}/warehouse", model)
    published = PublishedCardWarehouse(spark, f"{out}/warehouse")
    published.register_views()
    return published


def run_bills(spark: SparkSession, file: str, out: str, expected_rows: int | None = None) -> DataFrame:
    """The bill warehouse; returns the report view over its published tables."""
    publish_layer(spark, f"{out}/raw", {"bills": Landing(readers.read_bills(spark, file), expected_rows)})
    landed = open_published(spark, f"{out}/raw")
    raw = landed("bills")
    publish_layer(
        spark,
        f"{out}/staging",
        {"bills": Landing(bill_payments.stage_bills(raw), totals=bill_payments.staging_totals())},
        lambda read: enforce("bill staging", totals_of(read, "bills")),
    )

    def model(wh: bill_payments.BillWarehouse) -> None:
        enforce_rows("bill keys", wh.key_gate(), "table_name")
        enforce_rows("bill references", wh.reference_gate(), "key")
        counts = {name: int(n) for name, n in wh.load_check().first().asDict().items()}
        if len(set(counts.values())) > 1:
            raise RuntimeError(f"bill row counts differ: {counts}")

    run = open_published(spark, f"{out}/staging")
    known = {"raw_rows": landed.facts["bills"].rows, "staged_rows": run.facts["bills"].rows}
    bill_payments.BillWarehouse(spark, raw, run("bills"), known).publish(f"{out}/warehouse", model)
    report = bill_payments.report_from_tables(spark, f"{out}/warehouse")
    report.createOrReplaceTempView("vw_transaction_report")
    return report


def run_trauma(spark: SparkSession, file: str, out: str, expected_rows: int | None = None) -> DataFrame:
    """The access mart and its state summary, which is also exported as one file."""
    raw = readers.read_delimited(spark, file, schemas.HOSPITALS)
    publish_layer(spark, f"{out}/raw", {"hospitals": Landing(raw, expected_rows)})
    landed = read_published(spark, f"{out}/raw", "hospitals")
    unmapped = trauma_access.unmapped_designations(landed).limit(20).collect()
    if unmapped:
        raise RuntimeError(f"trauma designations without a mapping: {unmapped}")
    publish_layer(spark, f"{out}/staging", {"hospitals": Landing(trauma_access.stage_hospitals(landed))})
    staged = read_published(spark, f"{out}/staging", "hospitals")
    _report("null profile", trauma_access.null_profile(staged))
    _report("category", trauma_access.category_distribution(staged))
    wanted = trauma_access.in_scope(staged).count()
    publish_layer(
        spark,
        f"{out}/access",
        {"hospital_access": Landing(trauma_access.hospital_access(staged), wanted)},
        lambda read: enforce("distances", trauma_access.distance_gate(read("hospital_access"))),
    )
    access = read_published(spark, f"{out}/access", "hospital_access")

    def complete(read: Reader) -> None:
        total = trauma_access.summary_check(read("state_summary")).first()["total_hospitals"] or 0
        if total != wanted:
            raise RuntimeError(f"the state summary holds {total} of {wanted} hospitals")

    publish_layer(spark, f"{out}/mart", {"state_summary": Landing(trauma_access.state_summary(access))}, complete)
    summary = read_published(spark, f"{out}/mart", "state_summary")
    export_csv(summary, f"{out}/state_summary_csv", ["state"])
    return access


def main(argv: list[str]) -> None:
    run = {"card": run_card, "bills": run_bills, "trauma": run_trauma}[argv[0]]
    run(SparkSession.builder.appName(f"stellate {argv[0]}").getOrCreate(), *argv[1:3])


if __name__ == "__main__":
    main(sys.argv[1:])
