from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np

from stellate.llm import line_quality as lq
from tests.llm import awkward


def plain(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) for k in range(3) if count[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_statistics_match_brute_force(spark):
    rows = awkward.document_rows()
    got = lq.assess_documents(awkward.documents(spark), awkward.labels(spark)).collect()
    assert Counter((r[0], *r[1:7]) for r in got) == Counter((r[0], *plain(r[1])) for r in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(30):
        scores, moves = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))

        def value(path, scores=scores, moves=moves):
            return sum(scores[i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert value(lq.viterbi(scores, moves)) >= value(best) - 1e-9


def test_training_separates_held_out_lines(spark):
    clean = [prose.encode() for prose in (awkward.prose(120, s) for s in range(60))]
    junk = [" | ".join(awkward.words(60, s).split()).encode() for s in range(60)]
    chains = [(np.array(lq.lines_of(t)[0]), y) for part, y in ((clean[:40], 1), (junk[:40], 0)) for t in part]
    weights, moves = lq.fit(chains)
    assert all(lq.assess(t, weights, moves)[5] >= 0.5 for t in clean[40:])
    assert all(lq.assess(t, weights, moves)[5] < 0.5 for t in junk[40:])


def test_content_share_of_mixed_texts(spark):
    """Texts put together from good and bad ones of which the field has seen none: the share is that of the good one's words."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", "text", "quality").collect()
    by = [[r["text"].encode() for r in sorted(rows) if r["quality"] == s and len(r["text"].split()) >= 30 and "\n" in r["text"]] for s in (0, 1)]
    seen, unseen = [b[: len(b) // 2] for b in by], [b[len(b) // 2 :] for b in by]
    fitted = lq.fit([(np.array(lq.lines_of(t)[0][: lq.SAMPLE_LINES]), s) for s in (0, 1) for t in seen[s][:400]])
    off = []
    for i, (bad, good) in enumerate(zip(*unseen, strict=False)):
        parts = [(good, 1), (bad, 0)][:: 1 if i % 2 else -1] + ([(unseen[1][-1 - i], 1)] if i % 3 == 0 else [])
        words = [len(t.split()) for t, _ in parts]
        want = sum(n for n, (_, s) in zip(words, parts, strict=True) if s) / sum(words)
        off.append(abs(lq.assess(b"\n".join(t for t, _ in parts), *fitted)[5] - want))
    off = np.array(off)
    assert len(off) >= 40 and (off <= 0.1).mean() >= 0.85 and off.mean() <= 0.07, (len(off), (off <= 0.1).mean(), off.mean())


def test_chains_hold_changes_of_state():
    texts = [(np.full((3 + i, lq.FEATURES), i), i % 2) for i in range(9)]
    chains = lq.chains_of(texts)
    assert sum(len(x) for x, _ in chains) == sum(len(x) for x, _ in texts) and all(len(x) == len(y) for x, y in chains)
    assert {"".join(map(str, y[np.flatnonzero(np.diff(y, prepend=-1))])) for _, y in chains} == {"1010", "0101", "0"}
    assert all((y == x[:, 0] % 2).all() for x, y in chains)


def test_without_labels_only_the_base_rules_count(spark):
    got = lq.assess_documents(awkward.documents(spark), awkward.labels(spark, [])).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_keep_returns_all_columns_and_kept_rows(spark):
    docs, labels = awkward.documents(spark), awkward.labels(spark)
    kept = lq.keep(docs, labels)
    assert kept.columns == docs.columns
    want = Counter(r["doc_id"] for r in lq.assess_documents(docs, labels).collect() if r["kept"])
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_empty_table(spark):
    assert lq.assess_documents(awkward.empty(spark), awkward.labels(spark, [])).collect() == []


def test_gold_labels_on_the_generated_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = lq.assess_documents(docs, labels).join(labels, "doc_id").where("NOT base_failed").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in got]
    assert sum(right) / len(right) > 0.95
    assert all(r["kept"] for r in got if r["quality"] == 1)


def test_a_repeated_id_teaches_once(spark, monkeypatch):
    rows = [(i, awkward.prose(20 + i, i)) for i in range(30)] + [(0, awkward.prose(90, n)) for n in range(300)]
    fitted = []
    monkeypatch.setattr(lq, "fit", lambda texts: fitted.append(len(texts)))
    lq.train(spark.createDataFrame(rows, "doc_id long, text string"), awkward.labels(spark, [(i, i % 2, 0) for i in range(30)]))
    assert fitted == [30]
