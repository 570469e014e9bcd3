"""The pipeline against each stage's own rule, and the registered queries against their SQL."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from checks.compare import difference, duck
from stellate.llm import queries
from tests.llm import awkward
from tests.llm.test_decontaminate import brute
from tests.llm.test_line_quality import plain
from tests.llm.test_simhash import groups, plain_fingerprint

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = "file://" + str(tmp_path_factory.mktemp("pipeline"))
    rows = awkward.document_rows()
    item = " ".join(rows[10][1].split()[20:60])
    awkward.documents(spark, rows, clashes=False).write.parquet(f"{root}/documents.parquet")
    awkward.labels(spark).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, item


def test_stages_in_order(spark, tables):
    root, rows, item = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == columns, name
        seen.append(Counter((r["doc_id"], r["text"]) for r in docs.collect()))
    quality, lang, dedup, clean = seen
    passed = Counter((r[0], r[1]) for r in rows if not plain(r[1])[5])
    assert quality <= passed and lang <= quality
    assert {d for d, _ in quality} >= {i for i in range(1, 25) if i % 4}  # documents labelled good stay
    have = list(lang.elements())
    root_of = groups([plain_fingerprint(t) for _, t in have])
    assert {root_of[have.index(k)] for k in dedup} == set(root_of)  # a document of each group stays
    assert all(n == 1 for n in dedup.values())
    leaked = {d for d, *_ in brute([item], [(k, *k[1:]) for k in dedup])}
    assert set(clean) == set(dedup) - leaked and leaked


def test_run_packs_what_is_left(spark, tables):
    root, _, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
    got = corpus_pipeline.run(spark, root).collect()
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(r["doc_id"] for r in docs.collect())


def test_every_operator_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_a_row_per_row(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    source = "pages" if name.startswith(("op1_", "op7_")) else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    ids = {r[0] for r in spark.read.parquet(f"{SMALL}/{source}.parquet").select(key).collect()}
    found = {r[0] for r in got.select(key).collect()}
    assert found <= ids if name.startswith(("op6_", "op13_")) else found == ids
