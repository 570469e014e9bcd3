from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import xxhash

from stellate.llm import simhash
from stellate.llm.components import components
from tests.llm import awkward


def plain_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values: list[int], bits: int = 3) -> list[int]:
    """The index of the first value each one reaches."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_duplicates_match_brute_force_on_awkward_rows(spark):
    rows = awkward.document_rows()
    got = simhash.near_duplicates(awkward.documents(spark)).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = groups(prints)
    least: dict[int, int] = {}
    for r, g in zip(rows, root, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, root, strict=True))
    assert Counter(map(tuple, got)) == want


def test_spark_and_library_hash_alike(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a bc dé",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("a bc dé".encode(), 42)


@pytest.mark.parametrize("cell_rows", [4, 64, 4096])
def test_links_join_what_all_pairs_join(spark, cell_rows):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = set(rng.integers(0, 1 << 63, 150, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(40):  # crowded balls: many real links
            v = c
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = dict(map(tuple, components(simhash.links_between(prints, 3, cell_rows)).collect()))
    first = groups(values)
    members: dict[int, set] = {}
    for s, f in zip(signed, first, strict=True):
        members.setdefault(f, set()).add(s)
    want = {s: min(members[f]) for s, f in zip(signed, first, strict=True) if len(members[f]) > 1}
    assert roots == want


def test_forest_has_fewer_links_than_rows():
    base = np.arange(64, dtype=np.int64)
    assert len(simhash.forest(base, np.array([], np.int64), 3)) < 64


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1002), (1002, 1001), (5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_empty_table(spark):
    assert simhash.near_duplicates(awkward.empty(spark)).collect() == []
    assert simhash.one_of_each(awkward.empty(spark)).collect() == []


def survivors(rows: list[tuple]) -> Counter:
    """(id, text) of the row that stays of each group: smallest id, nulls last, then any text of that id."""
    root = groups([plain_fingerprint(r[1]) for r in rows])
    least: dict[int, tuple] = {}
    for r, g in zip(rows, root, strict=True):
        least[g] = min(least.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    return Counter(None if none else d for none, d in least.values())


@pytest.mark.parametrize("more", [[], [(0, 31), (1, 31), (1, 32), (7, 33), (7, 34), (None, 35), (None, 35), (9, 31), (None, 32), (0, 31)]])
def test_one_row_of_each_group_stays(spark, more):
    """Also of groups whose smallest id other rows have under unrelated texts."""
    rows = awkward.document_rows() + [(d, awkward.prose(60, 700 + t), None, None, None) for d, t in more]
    docs = awkward.documents(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert Counter(d for d, _ in got) == survivors(rows)
    root = dict(zip([(r[0], r[1]) for r in rows], groups([plain_fingerprint(r[1]) for r in rows]), strict=True))
    assert sorted(root[k] for k in got) == sorted(set(root.values()))  # every group, once
