from __future__ import annotations

import json

import pytest

from stellate.sources import publish, readers, schemas
from stellate.sources.publish import Landing, RowCountMismatch
from tests.conftest import rows_of


def test_unquoted_empty_is_null_and_quoted_is_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,a,b\n1,,""\n2,x,"say ""hi"", twice"\n')
    df = readers.read_delimited(spark, str(path), schemas.text_schema("id a b"))
    assert rows_of(df) == [("1", None, ""), ("2", "x", 'say "hi", twice')]
    assert {t for _, t in df.dtypes} == {"string"}


def test_columns_are_taken_by_name_in_any_order(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b,extra,a\n1,2,3\n")
    assert rows_of(readers.read_delimited(spark, str(path), schemas.text_schema("a b"))) == [("3", "1")]


def test_missing_column_stops_the_load(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,c\n1,2\n")
    with pytest.raises(readers.MissingColumns, match="b"):
        readers.read_delimited(spark, str(path), schemas.text_schema("a b"))


def test_bills_are_renamed_and_typed(spark, tmp_path):
    path = tmp_path / "bills.csv"
    header = ";".join(schemas.BILLS_RENAMED)
    path.write_text(f"{header}\nT1;2026-01-04;123;Budi  ;PLN;PLN Pasca ;9;1000;;1000;ATM;Sukses \n")
    row = readers.read_bills(spark, str(path)).first()
    assert (row.id_transaksi, row.tanggal, row.nominal, row.biaya_admin) == ("T1", "2026-01-04", 1000, None)
    assert row.status == "Sukses "


def test_sensitive_card_columns_are_never_stored(spark, tmp_path):
    path = tmp_path / "cards.csv"
    names = schemas.CARDS_FILE.fieldNames()
    path.write_text(",".join(names) + "\n" + ",".join(f"v_{n}" for n in names) + "\n")
    kept = readers.read_card_file(spark, str(path))
    assert not set(schemas.CARDS_SENSITIVE) & set(kept.columns)
    root = str(tmp_path / "raw")
    publish.publish_layer(spark, root, {"cards": Landing(kept, expected_rows=1)})
    stored = publish.read_published(spark, root, "cards")
    assert not set(schemas.CARDS_SENSITIVE) & set(stored.columns)
    assert not any("v_cvv" in str(v) for v in stored.first())


def test_empty_card_fields_land_as_empty_text(spark, tmp_path):
    path = tmp_path / "cards.csv"
    names = schemas.CARDS_FILE.fieldNames()
    path.write_text(",".join(names) + "\n1" + "," * (len(names) - 1) + "\n")
    assert readers.read_card_file(spark, str(path)).first().client_id == ""


def test_code_map(spark, tmp_path):
    path = tmp_path / "mcc.json"
    path.write_text(json.dumps({"5812": "Eating Places, Restaurants", "4829": 'Wires "x"'}, indent=1))
    assert rows_of(readers.read_code_map(spark, str(path))) == [("4829", 'Wires "x"'), ("5812", "Eating Places, Restaurants")]


@pytest.mark.parametrize("indent", [None, 2])
def test_label_object(spark, tmp_path, indent):
    labels = {str(i): "Yes" if i % 10 == 0 else "No" for i in range(1000)}
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"target": labels}, indent=indent))
    assert rows_of(readers.read_label_object(spark, str(path))) == sorted(labels.items(), key=repr)


def test_empty_label_object(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text('{"target": {}}')
    assert readers.read_label_object(spark, str(path)).count() == 0


def test_malformed_label_text_stops_the_load(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text('{"target": {"1": "Yes", "2" "No"}}')
    with pytest.raises(Exception, match="malformed label text"):
        readers.read_label_object(spark, str(path)).collect()


def test_mismatch_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "layer")
    first, second = spark.range(3), spark.range(5)
    assert publish.publish_layer(spark, root, {"t": Landing(first, 3)}) == {"t": 3}
    with pytest.raises(RowCountMismatch, match="t: got 5, expected 4"):
        publish.publish_layer(spark, root, {"t": Landing(second, 4)})
    assert publish.read_published(spark, root, "t").count() == 3
    publish.publish_layer(spark, root, {"t": Landing(second, 5)})
    assert publish.read_published(spark, root, "t").count() == 5


def test_year_folders_are_pruned(spark, tmp_path):
    root = str(tmp_path / "layer")
    df = spark.range(100).selectExpr("id", "CAST(2010 + id % 10 AS INT) AS year")
    publish.publish_layer(spark, root, {"t": Landing(df, 100, ("year",))})
    recent = publish.read_published(spark, root, "t").filter("year >= 2018")
    assert recent.count() == 20
    assert "PartitionFilters: [isnotnull(year" in recent._jdf.queryExecution().toString()


def test_export_quotes_text_only(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ('a"x', 1, 0.5), (None, 3, 1.0)], "state string, n int, r double")
    path = tmp_path / "out"
    publish.export_csv(df, str(path), ["n"])
    (part,) = path.glob("part-*")
    assert part.read_text().splitlines() == ['"state","n","r"', '"a""x",1,0.5', '"b",2,', ',3,1.0']


def test_views(spark):
    publish.register_views({"numbers": spark.range(2)}, "bi")
    assert spark.sql("SELECT count(*) FROM bi_numbers").first()[0] == 2
