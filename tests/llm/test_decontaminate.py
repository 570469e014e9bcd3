from __future__ import annotations

import random

import numpy as np

from stellate.llm import decontaminate as dc
from stellate.llm.common import plain_words
from tests.llm import awkward

ITEM = "item_id long, text string"


def best_distance(item: list[bytes], text: list[bytes]) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(words: list[str], edits: int, rng: random.Random) -> list[str]:
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.choice("sid")
        if kind == "s":
            words[at] = "zz" + str(rng.randrange(99))
        elif kind == "i":
            words.insert(at, "yy" + str(rng.randrange(99)))
        else:
            del words[at]
    return words


def planted(seed: int, n: int = 120):
    rng = random.Random(seed)
    items = [awkward.words(rng.randint(4, 60), 1000 + i) for i in range(25)]
    docs = []
    for i in range(n):
        body = awkward.words(rng.randint(0, 150), 5000 + i).split()
        if i % 2:
            item = rng.choice(items).split()
            most = int(0.2 * len(item) + 1e-9)
            at = rng.randint(0, len(body))
            body[at:at] = edited(item, rng.randint(0, most + 2), rng)
        docs.append((i, " ".join(body), None, None, None))
    return items, docs


def brute(items: list[str], docs: list[tuple]) -> set:
    out = set()
    for doc, text, *_ in docs:
        words = plain_words((text or "").encode())
        for i, item in enumerate(items):
            w = plain_words((item or "").encode())
            if w and best_distance(w, words) <= int(0.2 * len(w) + 1e-9):
                out.add((doc, i, best_distance(w, words)))
    return out


def test_leaks_match_brute_force(spark):
    items, docs = planted(1)
    bench = spark.createDataFrame(list(enumerate(items)), ITEM)
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in dc.leaks(awkward.documents(spark, docs), bench).collect()}
    want = brute(items, docs)
    assert got <= want and len(got) >= 0.99 * len(want) > 20


def test_recall_at_the_most_edits():
    rng = random.Random(8)
    items = [awkward.words(rng.randint(10, 60), 300 + i) for i in range(60)]
    index = dc.Index.of([i.encode() for i in items])
    found = 0
    for n, item in enumerate(items * 5):
        words = edited(item.split(), int(0.2 * len(item.split()) + 1e-9), rng)
        text = " ".join([awkward.words(20, n), *words, awkward.words(20, n + 1)])
        if best_distance(plain_words(item.encode()), plain_words(text.encode())) <= int(0.2 * len(item.split()) + 1e-9):
            found += any(f[1] == n % 60 for f in dc.find(index, [text.encode()]))
        else:
            found += 1
    assert found >= 0.99 * 300


def test_edit_distances_match_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        item, regions = rng.integers(1, 4, 6), rng.integers(1, 4, (5, 11))
        got, _ = dc.edit_distances(item, regions)
        letters = lambda x: [bytes([v]) for v in x.tolist()]
        assert got.tolist() == [best_distance(letters(item), letters(r)) for r in regions]


def test_embedding_keeps_equal_texts_equal_and_few_edits_near():
    rng = np.random.default_rng(10)
    a = rng.integers(1, 500, 50)
    b = a.copy()
    b[20] = 777
    steps = dc.WALK * 50
    walks = lambda x, r: dc.embed(x[None], steps, r)[0, : steps * 3 // 5]
    far = np.mean([(walks(a, r) != walks(rng.integers(1, 500, 50), r)).mean() for r in range(20)])
    near = np.mean([(walks(a, r) != walks(b, r)).mean() for r in range(20)])
    assert (dc.embed(a[None], steps, 0) == dc.embed(a[None].copy(), steps, 0)).all()
    assert near < 0.4 < 0.8 < far


def test_awkward_rows_and_blocks(spark, monkeypatch):
    rows = awkward.document_rows()
    item = " ".join(rows[3][1].split()[5:40])
    bench = spark.createDataFrame([(7, item), (8, item), (None, item), (9, None), (10, ""), (11, "!!!"), (12, "a")], ITEM)
    docs = awkward.documents(spark)
    got = dc.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["item_words"] > 1} == {(4, 7), (4, 8), (4, None)}
    assert {r["doc_id"] for r in got if r["item_id"] == 12} >= {105}
    monkeypatch.setattr(dc, "BLOCK_WORDS", 10)
    assert sorted(map(tuple, dc.leaks(docs, bench).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    kept = dc.clean(docs, bench.where("item_id = 7"))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1


def test_empty_tables(spark):
    bench = spark.createDataFrame([], ITEM)
    assert dc.leaks(awkward.documents(spark), bench).collect() == []
    assert dc.leaks(awkward.empty(spark), bench).collect() == []
    assert dc.clean(awkward.documents(spark), bench).count() == len(awkward.document_rows())


def test_recall_of_long_items():
    for size, trials in ((60, 40), (120, 20), (250, 20), (500, 12)):
        rng = random.Random(size)
        items = [awkward.words(size, 5000 + i) for i in range(4)]
        index = dc.Index.of([i.encode() for i in items])
        texts = []
        for n in range(trials):  # half of them lose words only
            words = items[n % 4].split()
            if n % 2:
                words = edited(words, size // 5, rng)
            else:
                words = [words[i] for i in sorted(rng.sample(range(size), size - size // 5))]
            texts.append(" ".join([awkward.words(20, n), *words, awkward.words(20, n + 1)]).encode())
        found = {(t, i) for t, i, *_ in dc.find(index, texts)}
        assert sum((n, n % 4) in found for n in range(trials)) >= 0.97 * trials


def test_repeated_items_are_looked_up_once(spark, monkeypatch):
    sizes = []
    lookup = dc._lookup
    monkeypatch.setattr(dc, "_lookup", lambda spark, text, rows, *rest: sizes.append(len(rows)) or lookup(spark, text, rows, *rest))
    item = awkward.words(30, 1)
    bench = spark.createDataFrame([(i, item) for i in range(50)] + [(50, awkward.words(30, 2))], ITEM)
    docs = spark.createDataFrame([(1, item)], "doc_id long, text string")
    got = dc.leaks(docs, bench).collect()
    assert sizes == [2] and sorted(r["item_id"] for r in got) == list(range(50))
