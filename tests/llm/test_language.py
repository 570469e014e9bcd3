from __future__ import annotations

import itertools
import zlib

import numpy as np

from stellate.llm import language
from tests.llm import awkward

DATA = "/root/testdata/sf0.1"


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(11, 3)).astype(np.float32) * 3
    start, count = np.array([0, 5, 5]), np.array([5, 0, 6])
    got = language.viterbi(scores, start, count, 2.0)
    for s, n in zip(start, count, strict=True):
        if n:
            part = scores[s : s + n]

            def value(path, part=part):
                return sum(part[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))

            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert value(got[s : s + n].tolist()) >= value(best) - 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixed_text_has_a_span_per_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.train(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("doc_id % 3 = 0 AND length(text) BETWEEN 600 AND 900").limit(400).collect()}
    mixed = "\n".join(texts[name][:600] for name in ("en", "de", "fr"))
    assert [name for name, _, _ in language.spans(model, mixed)] == ["en", "de", "fr"]


def test_scripts_narrow_candidates(spark):
    rows = [(i, "привет мир как дела " * 5 if i % 2 else "hello world how are you " * 5, "ru" if i % 2 else "en", None, None) for i in range(60)]
    rows += [(900, "слово дело", None, None, None), (901, "world", None, None, None), (902, "漢字", None, None, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(awkward.documents(spark, rows)).collect()}
    assert got[900] == "ru" and got[901] == "en" and got[902] in ("en", "ru")


def test_awkward_rows(spark):
    rows = awkward.document_rows()
    got = language.identify(awkward.documents(spark)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (100, 101, 102, 107)] == ["und"] * 4
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1) for r in got)
    kept = language.keep(awkward.documents(spark))
    assert kept.columns == awkward.documents(spark).columns
    assert {100, 101, 102, 107} & {r["doc_id"] for r in kept.collect()} == set()


def test_nothing_to_learn_from(spark):
    rows = [(1, "abc", None, None, None)]
    assert [tuple(r)[2:] for r in language.identify(awkward.documents(spark, rows)).collect()] == [("und", 0.0)]
    assert language.identify(awkward.empty(spark)).collect() == []


def learned_ids(n: int) -> list[int]:
    return [i for i in range(3 * n) if zlib.crc32(str(i).encode()) % 3 != 1][:n]


def test_every_language_is_learned(spark):
    rows = [(i, awkward.words(20, i), f"l{n:03}") for n, i in enumerate(learned_ids(300))]
    assert len(language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 300


def test_copies_of_a_text_teach_once(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_PER_LANGUAGE", 50)
    ids = learned_ids(100)
    rows = [(i, awkward.words(20, i), "ab"[i % 2]) for i in ids]
    copied = rows + [(ids[n % 100], rows[t][1], rows[t][2]) for t in (0, 1, 2, 3, 4, 5, 6, 7) for n in range(60)]
    once, often = (language.train(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, copied))
    assert once.languages == often.languages == ("a", "b") and (once.scores == often.scores).all()
