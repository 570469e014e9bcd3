"""Ranked search against scoring every pair, and against SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stellate.llm import dual_tree
from tests.llm import awkward

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[list[tuple]]:
    """Per item the (rank, doc_id, score) of its list."""
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for _, text in items:
        found = []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * n) // total if total else 0
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(TERM.findall((text or "").translate(LOWER)))
                if t in c
            )
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out.append([(i, d, -s) for i, (s, _, _, d) in enumerate(found[:k], 1)])
    return out


def rows(docs: list[tuple]) -> list[tuple]:
    return [(d, t, None, None, None) for d, t in docs]


def compare(spark, docs, items, k, **more):
    got = dual_tree.search(
        awkward.documents(spark, rows(docs)), spark.createDataFrame(items, "item_id long, text string"), k=k, **more
    ).collect()
    want = Counter((i[0], *r) for i, some in zip(items, brute(docs, items, k), strict=True) for r in some)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == want
    return want


ITEMS = [(1, awkward.prose(40, 3)), (2, awkward.prose(25, 4)), (2, awkward.prose(25, 4)), (3, None), (4, ""), (5, "no such wordsatall"),
         (None, "la la Ünïcode 漢字"), (6, "a"), (7, "A 123 ß")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_awkward_rows(spark, k):
    docs = [(r[0], r[1]) for r in awkward.document_rows()]
    assert compare(spark, docs, ITEMS, k)


@pytest.mark.parametrize("block_bytes", [dual_tree.BLOCK_BYTES, 60])
def test_many_documents_with_copies_and_ties(spark, block_bytes):
    rng = random.Random(5)
    words = [awkward.words(1, i) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 3, 12, 60])))) for i in range(1500)]
    docs += [(rng.randrange(5000), docs[7][1]) for _ in range(600)]  # a large group of copies, ties at the last rank
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 20])))) for i in range(30)] + [(99, docs[7][1])]
    compare(spark, docs, items, 20, block_bytes=block_bytes)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dual_tree.search(awkward.empty(spark), items).collect() == []
    assert dual_tree.search(awkward.documents(spark), items.limit(0)).collect() == []
    assert dual_tree.search(awkward.documents(spark), items.where("text is null")).collect() == []


def test_pairs_are_left_out_but_never_a_result():
    """Documents of four subjects: lists are right, and most pairs are never scored."""
    rng = np.random.default_rng(1)
    n, terms, k = 3000, 400, 10
    row, term, tf = [], [], []
    for d in range(n):
        some = rng.choice(100, 12, replace=False) + 100 * (d % 4)
        row += [d] * 12
        term += sorted(some.tolist())
        tf += rng.integers(1, 4, 12).tolist()
    row, term, tf = np.array(row), np.array(term), np.array(tf)
    length = rng.integers(20, 2000, n)
    impact = dual_tree.impacts(tf, row, length, n, int(length.sum()))
    weights = rng.integers(1, 9000, terms)
    items = [np.sort(rng.choice(100, 8, replace=False)) + 100 * (i % 4) for i in range(24)]
    ids = rng.permutation(n)
    best = dual_tree.Best(len(items), k, np.zeros(len(items), np.int64))
    pairs = scored = 0
    tree = dual_tree.item_tree(items)
    for a in range(0, n, 1000):
        mine = (row >= a) & (row < a + 1000)
        docs = dual_tree.DocumentTree(ids[a : a + 1000], np.zeros(1000, bool), row[mine] - a, term[mine], impact[mine], length[a : a + 1000], terms)
        p, s = docs.search(tree, weights, best)
        pairs, scored = pairs + p, scored + s
    dense = np.zeros((n, terms), np.int64)
    dense[row, term] = impact
    for i, some in enumerate(items):
        score = dense[:, some] @ weights[some]
        order = [o for o in np.lexsort((ids, -score))[:k] if score[o] > 0]
        assert best.doc[i].tolist() == ids[order].tolist() and best.score[i].tolist() == score[order].tolist()
    assert pairs == n * len(items) and scored < pairs / 2


def test_sums_beyond_doubles_stay_exact():
    value = np.array([(1 << 53) + 1, 1, 3])
    assert dual_tree._sums(np.array([0, 0, 1]), value, 2).tolist() == [(1 << 53) + 2, 3]
