"""The three jobs from files to published layers, and what stops them."""

from __future__ import annotations

import csv
import json

import pytest

from pyspark.sql import functions as F

from stellate import jobs
from stellate.operators.gates import GateFailed
from stellate.plans import bill_payments, card_reports
from stellate.plans import card_warehouse as cw
from stellate.sources import publish, schemas
from stellate.sources.publish import RowCountMismatch, read_published
from tests import test_bills_hospitals_retail as other
from tests import test_card as card

# Without the row that has no day of its own: 3 January gets a transaction instead.
TRANSACTIONS = card.TRANSACTIONS + [
    ("7", "2017-01-03 12:00:00", "1", "11", "$30.00", "Chip Transaction", "7", "Austin", "TX", "58523.0", "3999", None)
]


def write_csv(path, names, rows, sep=","):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, delimiter=sep)
        writer.writerow(names)
        writer.writerows([["" if v is None else v for v in row] for row in rows])


def card_folder(tmp_path, transactions=TRANSACTIONS):
    folder = tmp_path / "files"
    folder.mkdir()
    write_csv(folder / "transactions_data.csv", schemas.TRANSACTIONS.fieldNames(), transactions)
    write_csv(folder / "users_data.csv", schemas.USERS.fieldNames(), card.USERS)
    sensitive = {name: "secret" for name in schemas.CARDS_SENSITIVE}
    kept = schemas.CARDS.fieldNames()
    write_csv(
        folder / "cards_data.csv",
        schemas.CARDS_FILE.fieldNames(),
        [[{**dict(zip(kept, row)), **sensitive}[n] for n in schemas.CARDS_FILE.fieldNames()] for row in card.CARDS],
    )
    (folder / "mcc_codes.json").write_text(json.dumps(dict(card.MCC)))
    (folder / "train_fraud_labels.json").write_text(json.dumps({"target": dict(card.LABELS)}))
    return str(folder)


def test_card_job(spark, tmp_path):
    out = str(tmp_path / "out")
    expected = {"transactions": 7, "users": 2, "cards": 4, "mcc": 6, "fraud_labels": 4}
    folder = card_folder(tmp_path)
    for _ in range(2):  # safe to run again
        wh = jobs.run_card(spark, folder, out, expected)
    assert card_reports.label_coverage(wh).first().all_rows == 6
    assert spark.sql("SELECT count(*) FROM bi_dim_date").first()[0] == 5
    assert "secret" not in str(read_published(spark, f"{out}/raw", "cards").collect())


def test_card_job_stops_on_a_short_file(spark, tmp_path):
    with pytest.raises(RowCountMismatch, match="transactions: got 7, expected 8"):
        jobs.run_card(spark, card_folder(tmp_path), str(tmp_path / "out"), {"transactions": 8})
    assert not (tmp_path / "out" / "raw" / "pointers").exists()


def test_card_job_stops_at_the_staging_gate(spark, tmp_path):
    bad = TRANSACTIONS + [("8", "2017-01-03 12:00:00", "77", "11", "$1.00", "Chip Transaction", "7", "Austin", "TX", None, "3999", None)]
    with pytest.raises(GateFailed, match="orphan_clients"):
        jobs.run_card(spark, card_folder(tmp_path, bad), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "staging" / "pointers").exists()
    assert not (tmp_path / "out" / "warehouse").exists()


LATE = ("8", "2020-01-05 12:00:00", "1", "11", "$1.00", "Chip Transaction", "7", "Austin", "TX", "58523.0", "3999", None)


def test_card_job_stops_at_what_reports_would_lose_or_count_twice(spark, tmp_path, monkeypatch):
    folder, out = card_folder(tmp_path), str(tmp_path / "out")
    before = card_reports.label_coverage(jobs.run_card(spark, folder, out)).collect()
    faults = {
        "unmatched_date": ("transactions_data.csv", schemas.TRANSACTIONS.fieldNames(), [*TRANSACTIONS, LATE]),
        "dim_client.duplicate_keys": ("users_data.csv", schemas.USERS.fieldNames(), [*card.USERS, card.USERS[0]]),
    }
    for match, (name, columns, rows) in faults.items():
        good = (tmp_path / "files" / name).read_text()
        write_csv(tmp_path / "files" / name, columns, rows)
        with pytest.raises(GateFailed, match=match):
            jobs.run_card(spark, folder, out)
        (tmp_path / "files" / name).write_text(good)
    cards = tmp_path / "files" / "cards_data.csv"
    lines = cards.read_text().splitlines()
    cards.write_text("\n".join([*lines, lines[1]]) + "\n")
    with pytest.raises(GateFailed, match="dim_card.duplicate_keys"):
        jobs.run_card(spark, folder, out)
    # the run before the faults is still what readers see
    assert card_reports.label_coverage(cw.PublishedCardWarehouse(spark, f"{out}/warehouse")).collect() == before


def test_card_job_reads_raw_transactions_and_joins_labels_once(spark, tmp_path, monkeypatch):
    reads = []
    wh = jobs.CardWarehouse
    monkeypatch.setattr(cw, "attach_labels", lambda t, l, f=cw.attach_labels: (reads.append("labels"), f(t, l))[1])
    monkeypatch.setattr(cw, "type_transactions", lambda raw, f=cw.type_transactions: (reads.append("raw"), f(raw))[1])
    jobs.run_card(spark, card_folder(tmp_path), str(tmp_path / "out"))
    assert wh is cw.CardWarehouse and sorted(reads) == ["labels", "raw"]


def test_readers_hold_on_to_one_run(spark, tmp_path):
    root = str(tmp_path / "layer")
    for n in (1, 2):
        tables = {name: publish.Landing(spark.range(n).withColumn("t", F.lit(name))) for name in ("a", "b")}
        publish.publish_layer(spark, root, tables)
        if n == 1:
            held = publish.open_published(spark, root)
    assert (held("a").count(), held("b").count()) == (1, 1)
    assert publish.read_published(spark, root, "a").count() == 2
    assert [number for number, _ in publish.published_runs(spark, root)] == [1, 2]

    def fail(read):
        assert read("a").count() == 3
        raise RuntimeError("crash before the switch")

    with pytest.raises(RuntimeError, match="crash"):
        publish.publish_layer(spark, root, {"a": publish.Landing(spark.range(3))}, fail)
    assert publish.read_published(spark, root, "a").count() == 2
    with pytest.raises(FileNotFoundError):
        publish.open_published(spark, str(tmp_path / "nothing"))


def test_bill_job_stops_at_rows_without_a_key(spark, tmp_path):
    path = tmp_path / "bills.csv"
    at = list(schemas.BILLS_RENAMED).index("Nama Biller")
    kind = list(schemas.BILLS_RENAMED).index("Jenis Biller")

    def changed(row, column, value):
        return [value if i == column else v for i, v in enumerate(row)]

    faults = {
        "dim_biller.null_keys": [*other.BILLS[:-1], changed(other.BILLS[-1], at, None)],
        "dim_biller.duplicate_keys": [*other.BILLS, ["T99", *changed(other.BILLS[0], kind, "Another kind")[1:]]],
    }
    for match, rows in faults.items():
        write_csv(path, list(schemas.BILLS_RENAMED), rows, sep=";")
        with pytest.raises(GateFailed, match=match):
            jobs.run_bills(spark, str(path), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "warehouse" / "pointers").exists()


def test_bill_job(spark, tmp_path):
    path = tmp_path / "bills.csv"
    write_csv(path, list(schemas.BILLS_RENAMED), other.BILLS, sep=";")
    report = jobs.run_bills(spark, str(path), str(tmp_path / "out"), 4)
    assert {r.month_name: r.total_transactions for r in bill_payments.volume_per_month(report).collect()} == {
        "January": 3, "April": 1}
    write_csv(path, list(schemas.BILLS_RENAMED), other.BILLS + other.BILLS[:1], sep=";")
    with pytest.raises(GateFailed, match="fact_transactions.duplicate_keys"):
        jobs.run_bills(spark, str(path), str(tmp_path / "out"))


def test_trauma_job(spark, tmp_path):
    path = tmp_path / "hospitals.csv"
    names = schemas.HOSPITALS.fieldNames()
    usable = [row for row in other.HOSPITALS if row[names.index("id")] not in ("3", "9")]
    write_csv(path, names, usable)
    access = jobs.run_trauma(spark, str(path), str(tmp_path / "out"), len(usable))
    assert access.count() == 5
    (part,) = (tmp_path / "out" / "state_summary_csv").glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[0].startswith('"state","n_hospitals","n_sites"') and [x.split(",")[0] for x in lines[1:]] == ['"LA"', '"TX"']
    write_csv(path, names, other.HOSPITALS)
    with pytest.raises(RuntimeError, match="NEW ONE"):
        jobs.run_trauma(spark, str(path), str(tmp_path / "out"))
