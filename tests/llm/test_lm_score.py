from __future__ import annotations

import math
from collections import Counter

import pytest

from stellate.llm import lm_score
from stellate.llm.common import plain_words
from tests.llm import awkward


def brute(rows: list[tuple]) -> list[tuple]:
    texts = [plain_words((r[1] or "").encode()) for r in rows]
    one, two = Counter(), Counter()
    for w in texts:
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    total = sum(one.values())
    out = []
    for r, w in zip(rows, texts, strict=True):
        value, backed = 0.0, 0
        for i, x in enumerate(w):
            if i and two[w[i - 1], x] >= 2:
                value += math.log(two[w[i - 1], x] / one[w[i - 1]])
            else:
                value += math.log(one[x] / total) + (math.log(0.4) if i else 0)
                backed += i > 0
        out.append((str(r[0]), len(w), backed, round(value, 5)))
    return sorted(out)


@pytest.mark.parametrize("block,bucket", [(1 << 20, 1 << 19), (300, 1 << 19), (1000, 50)])
def test_scores_match_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(lm_score, "BUCKET_GRAMS", bucket)
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", block)
    rows = awkward.document_rows() + [(500 + i, "one very common line of words", None, None, None) for i in range(200)]
    got = lm_score.score(awkward.documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_backoff"], round(r["log_score"], 5)) for r in got) == brute(rows)
    assert all(r["score"] == pytest.approx(r["log_score"] / r["n_words"] if r["n_words"] else 0.0) for r in got)


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("a", "x y x y"), (None, "")], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in lm_score.score(df).collect()) == ["None", "a"]


def test_empty_table(spark):
    assert lm_score.score(awkward.empty(spark)).collect() == []
