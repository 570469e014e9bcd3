"""Quoted separators, read from files of many splits, against Python's and DuckDB's readers."""

from __future__ import annotations

import csv
import json
import random

import duckdb
import pytest

from stellate.sources import readers, schemas
from stellate.sources.quoted import MalformedSource, csv_quotes, whole_records
from tests.conftest import rows_of

COLUMNS = schemas.text_schema("id note amount")


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(seed, n=150):
    rng = random.Random(seed)
    parts = ["a", "b c", "\n", "\n\n", '"', '""', ",", "é", "x" * 90, "\r\n", ";"]
    return [(str(i), "".join(rng.choices(parts, k=rng.randint(1, 9))), str(rng.randint(0, 999))) for i in range(n)]


def write(path, rows, end):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
        writer.writerow(["id", "note", "amount"])
        writer.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_in_quotes(spark, tmp_path, small_splits, end):
    rows = made(1)
    write(tmp_path / "a.csv", rows, end)
    write(tmp_path / "b.csv", made(2, 40), end)
    both = rows + made(2, 40)
    out = readers.read_delimited(spark, str(tmp_path), COLUMNS, line_breaks=True)
    assert rows_of(out) == sorted(both, key=repr)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10  # records lie across splits
    duck = duckdb.sql(f"SELECT * FROM read_csv('{tmp_path}/*.csv', header = true, all_varchar = true, quote = '\"', escape = '\"', delim = ',', new_line = '{'\\r\\n' if end == '\r\n' else '\\n'}')")
    assert sorted(duck.fetchall(), key=repr) == sorted(both, key=repr)


def test_empty_fields_and_plain_files(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text('amount,id,note\n1,"",\n2,,"two\nlines"\n\n"3",c,""\n')
    out = readers.read_delimited(spark, str(tmp_path / "x.csv"), COLUMNS, line_breaks=True)
    assert rows_of(out) == sorted([("", None, "1"), (None, "two\nlines", "2"), ("c", "", "3")], key=repr)
    (tmp_path / "y.csv").write_text("id,note,amount\n1,a,2\n")
    assert rows_of(readers.read_delimited(spark, str(tmp_path / "y.csv"), COLUMNS, line_breaks=True)) == [("1", "a", "2")]


def test_what_stops_the_load(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,note,amount\n1,"never closed,2\n')
    with pytest.raises(MalformedSource, match="ends inside quotes"):
        readers.read_delimited(spark, str(tmp_path / "open.csv"), COLUMNS, line_breaks=True)
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text('id,note,amount\n1,"a\nb",2\n')
    (folder / "b.csv").write_text('note,id,amount\n1,"a\nb",2\n')
    with pytest.raises(MalformedSource, match="headers differ"):
        readers.read_delimited(spark, str(folder), COLUMNS, line_breaks=True)
    (tmp_path / "short.csv").write_text('id,note,amount\n1,"a\nb"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_delimited(spark, str(tmp_path / "short.csv"), COLUMNS, line_breaks=True).collect()


def test_records_are_numbered_in_file_order(spark, tmp_path, small_splits):
    rows = made(5)
    write(tmp_path / "a.csv", rows, "\n")
    got = {r["record"]: r["value"] for r in whole_records(spark, str(tmp_path), "\n", csv_quotes).collect()}
    parsed = [next(csv.reader([got[i + 1]])) if "\n" not in got[i + 1] else None for i in range(len(rows))]
    assert len(got) == len(rows) + 1 and all(p is None or p == list(r) for p, r in zip(parsed, rows, strict=True))


@pytest.mark.parametrize("indent", [None, 2])
def test_objects_with_commas_quotes_and_escapes(spark, tmp_path, small_splits, indent):
    rng = random.Random(3)
    parts = ["a", ",", '"', "\\", "\n", "é", "{", "}", ":", " ", "\\,", '",']
    held = {f"{i},{''.join(rng.choices(parts, k=2))}": "".join(rng.choices(parts, k=rng.randint(0, 6))) for i in range(200)}
    for name, read, shape in (("codes", readers.read_code_map, held), ("labels", readers.read_label_object, {"target": held})):
        path = tmp_path / f"{name}{indent}.json"
        path.write_text(json.dumps(shape, indent=indent))
        assert rows_of(read(spark, str(path))) == sorted(held.items(), key=repr)
        assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 10


def test_a_code_without_text_stops_the_load(spark, tmp_path):
    (tmp_path / "codes.json").write_text('{"1": "a", "2": 5}')
    with pytest.raises(Exception, match="malformed code text"):
        readers.read_code_map(spark, str(tmp_path / "codes.json")).collect()
