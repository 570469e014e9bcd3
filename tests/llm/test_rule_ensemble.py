from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellate.llm import rule_ensemble as re_
from tests.llm import awkward

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = re_.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_compiled_expression_equals_the_rules(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, len(re_.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.4)).astype(float)
    model = re_.fit(x, y)
    assert 0 < len(model.rules) < 80
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, s array<double>")
    got = [r[0] for r in rows.select("i", model.score(F.col("s")).alias("p")).orderBy("i").select("p").collect()]
    margin = model.intercept + sum(w * re_.covers(r, x) for r, w in model.rules)
    assert got == pytest.approx((1 / (1 + np.exp(-margin))).tolist())
    assert np.mean((np.array(got) > 0.5) == y) > 0.95


def test_lasso_drops_what_says_nothing():
    rng = np.random.default_rng(4)
    z = rng.integers(0, 2, (500, 20)).astype(float)
    y = (z[:, 3] > 0).astype(float)
    _, w = re_.lasso(z, y, 0.02)
    assert w[3] > 1 and np.count_nonzero(w) < 8


def test_awkward_rows(spark):
    rows = awkward.document_rows()
    got = re_.classify(awkward.documents(spark), awkward.labels(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (100, 101, 102)}) == 1


def test_held_out_labels_teach_nothing(spark):
    docs = awkward.documents(spark)
    given = [(i, int(i % 2)) for i in range(1, 25)]
    held = {i for i, _ in given if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = [(i, 1 - q if i in held else q, 0) for i, q in given]
    one = {str(r) for r in re_.classify(docs, awkward.labels(spark, [(i, q, 0) for i, q in given])).collect()}
    two = {str(r) for r in re_.classify(docs, awkward.labels(spark, flipped)).collect()}
    assert held and one == two


def test_without_labels_and_rows(spark):
    scores = {r["score"] for r in re_.classify(awkward.documents(spark), awkward.labels(spark, [])).collect()}
    assert scores == {0.5}
    assert re_.classify(awkward.empty(spark), awkward.labels(spark)).collect() == []
    one = re_.fit(np.ones((3, len(re_.STATISTICS))), np.ones(3))
    assert one.rules == () and one.intercept == pytest.approx(math.log(4))


def test_a_repeated_id_teaches_once(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, awkward.prose(20 + i, i)) for i in ids] + [(ids[0], awkward.prose(90, n)) for n in range(300)]
    labels = awkward.labels(spark, [(i, n % 2, 0) for n, i in enumerate(ids)])
    fitted = []
    monkeypatch.setattr(re_, "fit", lambda x, y: fitted.append(x.shape) or re_.Ensemble(0.0, ()))
    re_.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert fitted == [(len(ids), len(re_.STATISTICS))]
