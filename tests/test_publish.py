"""What a run's manifest knows, how tables are laid out, and that gates and joins make use of both."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stellate.plans import card_warehouse as cw
from stellate.sources import publish
from stellate.sources.publish import Landing
from tests import test_card as card
from tests.conftest import rows_of


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans_of(df, folder: str) -> int:
    """Scans of a table's files in the analysed plan, before Spark shares equal ones."""
    return sum(folder in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def numbers(spark, n=1000):
    return spark.range(n).selectExpr(
        "id", "CAST(2015 + id % 4 AS INT) AS year", "CAST(id * 7 % 360 AS INT) AS day", "CAST(id / 4 AS DECIMAL(12,2)) AS v", "IF(id % 10 = 3, NULL, id) AS w"
    )


def test_totals_and_extremes_are_those_of_the_written_rows(spark, tmp_path):
    root = str(tmp_path / "layer")
    landing = Landing(
        numbers(spark), partition_by=("year",), extremes=("day", "w"),
        totals={"nulls": F.count_if(F.col("w").isNull()), "sum": F.sum("v"), "none": F.sum(F.lit(None).cast("int"))},
    )
    seen = {}
    publish.publish_layer(spark, root, {"t": landing, "empty": Landing(numbers(spark, 0), extremes=("day",))}, lambda read: seen.update(read.facts))
    for facts in (seen, publish.open_published(spark, root).facts):
        t = facts["t"]
        assert (t.rows, t.totals["nulls"], float(t.totals["sum"]), t.totals["none"]) == (1000, "100", 124875.0, None)
        assert (t.least, t.greatest) == ({"day": 0, "w": 0}, {"day": 359, "w": 999}) and t.files >= 4
        assert facts["empty"].rows == 0 and facts["empty"].greatest == {"day": None}
    assert publish.totals_of(publish.open_published(spark, root), "t").first().asDict()["nulls"] == 100


def test_a_missing_file_is_noticed(spark, tmp_path):
    root = tmp_path / "layer"
    publish.publish_layer(spark, str(root), {"t": Landing(numbers(spark).repartition(4))})
    read = publish.open_published(spark, str(root))
    assert read("t").count() == 1000
    next(root.glob("run=*/t/part-*")).unlink()
    with pytest.raises(publish.MissingFiles, match="3 of 4"):
        read("t")


def test_old_runs_are_removed_and_the_current_one_stays(spark, tmp_path):
    root = tmp_path / "layer"
    for n in (3, 4, 5):
        publish.publish_layer(spark, str(root), {"t": Landing(spark.range(n))})
    assert len(publish.remove_old_runs(spark, str(root), keep=2)) == 1
    assert len(list(root.glob("run=*"))) == len(list(root.glob("manifests/run=*"))) == 2
    publish.remove_old_runs(spark, str(root))
    assert publish.read_published(spark, str(root), "t").count() == 5 and len(list(root.glob("run=*"))) == 1
    publish.publish_layer(spark, str(root), {"t": Landing(spark.range(6))})
    assert [n for n, _ in publish.published_runs(spark, str(root))] == [3, 4]
    with pytest.raises(ValueError):
        publish.remove_old_runs(spark, str(root), keep=0)


@pytest.fixture
def whole_files(spark):
    """Small partitions stay apart, as they would at scale."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_range_of_days_lies_in_few_files(spark, tmp_path, whole_files):
    root = str(tmp_path / "layer")
    hot = numbers(spark, 6000).withColumn("day", F.expr("IF(id % 3 = 0, 100, day)"))  # one day has a third of the rows
    publish.publish_layer(spark, root, {"t": Landing(hot, partition_by=("year",), order_by=("day", "id"))})
    t = publish.read_published(spark, root, "t")
    assert rows_of(t.select(*hot.columns)) == rows_of(hot)
    files = len(t.inputFiles())
    month = t.filter("year = 2016 AND day BETWEEN 200 AND 229").select(F.input_file_name()).distinct().count()
    held = t.filter("day = 100").select(F.input_file_name()).distinct().count()
    assert month <= files / 3 and held >= files / 3  # the hot day is spread
    sizes = [r["n"] for r in t.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 6000 / 4


def test_buckets_join_and_group_without_a_shuffle(spark, tmp_path):
    root = str(tmp_path / "layer")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = numbers(spark).drop("year")
        some = rows.filter("id % 3 = 0").selectExpr("id", "day AS other")
        ids = {"bucket_by": "id", "buckets": 8}
        publish.publish_layer(spark, root, {"a": Landing(rows, **ids), "b": Landing(some, 334, **ids)})
        read = publish.open_published(spark, root)
        joined = read("a").join(read("b"), "id", "left")
        assert "Exchange" not in plan_of(joined) and "Exchange" not in plan_of(read("a").groupBy("id").count())
        assert rows_of(joined) == rows_of(rows.join(some, "id", "left"))
        assert publish.open_published(spark, root)("a").count() == 1000  # named again by another reader
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("rows", "buckets"), [(0, 8), (16_000_000, 8), (16_000_001, 16), (10**12, 1 << 16)])
def test_bucket_numbers(rows, buckets):
    assert publish.buckets_for(rows) == buckets


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    """The small card warehouse, staged and published, with its runs' readers."""
    root = str(tmp_path_factory.mktemp("layers"))
    card.warehouse(spark).publish_staging(f"{root}/staging")
    staged = cw.StagedCardWarehouse(spark, publish.open_published(spark, f"{root}/staging"))
    staged.publish(f"{root}/warehouse")
    return staged, cw.PublishedCardWarehouse(spark, publish.open_published(spark, f"{root}/warehouse"), staged=staged)


def test_gates_scan_what_they_must(layers):
    """Row counters come from the write: of the staged transactions only keys and places are read again, of the facts only days."""
    staged, wh = layers
    assert scans_of(cw.staging_gate(staged), "stellate_transactions") == 1
    assert scans_of(cw.channel_disagreement(staged), "parquet") == 0
    gate = cw.reconciliation_gate(wh)
    assert scans_of(gate, "stellate_transactions") == 1  # places
    assert scans_of(gate, "parquet") <= 6  # that, the fact's days, days twice, places
    fact = [x for x in gate._jdf.queryExecution().optimizedPlan().toString().splitlines() if "error_keys" in x and "Relation" in x]
    assert len(fact) == 1
    assert scans_of(cw.sizes(wh), "parquet") == 0
    assert "error_keys" not in wh.window_calendar._jdf.queryExecution().optimizedPlan().toString()


def test_gates_say_the_same_from_the_write_and_from_the_frames(spark, layers):
    staged, wh = layers
    lazy = card.warehouse(spark)
    for gate in (cw.staging_gate, cw.channel_disagreement):
        assert gate(staged).first().asDict() == gate(lazy).first().asDict()
    for gate in (cw.reconciliation_gate, cw.sizes):
        assert gate(wh).first().asDict() == gate(lazy).first().asDict()
    assert rows_of(wh.window_calendar.select("date_key")) == rows_of(lazy.window_calendar.select("date_key"))
    assert cw.id_gate(staged).filter("duplicate_keys + null_keys > 0").count() == 0


def test_ids_are_grouped_where_they_lie(spark, layers):
    staged, _ = layers
    assert "hashpartitioning(transaction_id" not in plan_of(cw.id_gate(staged))
    relabelled = cw.attach_labels(staged.transactions.drop("has_fraud_label", "is_fraud"), staged.labels)
    assert "hashpartitioning(transaction_id" not in plan_of(relabelled)
    assert rows_of(relabelled.select(*staged.transactions.columns)) == rows_of(staged.transactions)
