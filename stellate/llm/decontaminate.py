"""Benchmark decontamination by edit distance.

A benchmark item leaks into a text if some run of the text's words is within ``1 - similarity`` of the item's length in word edits.
An item has k + 1 pieces, and its segments, of at most about SEGMENT_WORDS words, have some of them each. k edits leave some
segment with fewer edits than pieces, so with a whole piece; windows of a segment's size are laid where a piece of it
occurs, so no leak is without a window. Segment and window are embedded by CGK random walks, which turn
few edits into few differing places, and which drift apart over long texts, so that whole items are not embedded; windows that
agree with their segment on sampled places in any of several repeats go on, and a banded edit distance of the
item over the window's surroundings verifies them exactly.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.llm.common import plain_words, release_memory, unique_prefix, utf8

SIMILARITY = 0.8
#: A repeat agrees on this many places; places of an embedded leak that agree at worst, and the recall aimed at.
SAMPLED, AGREEING, RECALL = 2, 0.35, 0.99
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREEING**SAMPLED))
WALK = 3  # steps per word
SEGMENT_WORDS = 30  # walks that long agree as said above
#: Expected words of a block of benchmark items; blocks are looked up one after the other.
BLOCK_WORDS = 500_000
_WORDS_AT_ONCE, _WINDOWS_AT_ONCE, _CELLS_AT_ONCE = 1 << 19, 1 << 13, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def embed(windows: np.ndarray, steps: int, repeat: int) -> np.ndarray:
    """CGK walks of the rows of ``windows`` (word ids, 0 past the end): the word under the walk at each step.

    At a step the word is written out, and a coin that depends on the repeat, the step and the word alone
    tells whether the walk moves on.
    """
    n, width = windows.shape
    at = np.zeros(n, np.int64)
    rows = np.arange(n)
    padded = np.concatenate([windows, np.zeros((n, 1), windows.dtype)], axis=1)
    out = np.zeros((n, steps), windows.dtype)
    for j in range(steps):
        word = padded[rows, at]
        out[:, j] = word
        seed = np.uint64((repeat * 1_000_003 + j + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        coin = _mix(word.astype(np.uint64) * _BASE + seed) >> np.uint64(63)
        at = np.minimum(at + coin.astype(np.int64), width)
    return out


def sampled_places(steps: int, repeat: int) -> np.ndarray:
    """Places among the first steps, in which a walk has seldom reached the end, where all texts agree."""
    steps = max(1, steps * 3 // 5)
    return np.sort(np.random.default_rng([steps, repeat]).choice(steps, min(SAMPLED, steps), replace=False))


def edit_distances(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least word edits from ``item`` to any run inside each row of ``regions``, and where the best run ends."""
    n, width = regions.shape
    place = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64)  # a run may start anywhere
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (regions != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - place, axis=1) + place
    return row.min(axis=1), row.argmin(axis=1)


@dataclass
class Index:
    """Benchmark items as word ids, their segments (item, first word, word after the last) and their pieces by length."""

    similarity: float = SIMILARITY
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)
    edits: list[int] = field(default_factory=list)
    segments: list[tuple[int, int, int]] = field(default_factory=list)
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._embedded: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of(cls, texts: list[bytes], similarity: float = SIMILARITY) -> Index:
        """Items in the order given; an item without words matches nothing."""
        index = cls(similarity)
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for number, text in enumerate(texts):
            words = plain_words(text)
            ids = np.array([index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in words], np.int64)
            k = int((1 - similarity) * len(words) + 1e-9)
            index.items.append(ids)
            index.edits.append(k)
            if not len(ids):
                continue
            size = len(ids) // (k + 1)
            codes = _codes(ids, size)
            places = [piece * len(ids) // (k + 1) for piece in range(k + 1)]
            parts = min(k + 1, math.ceil(len(ids) / SEGMENT_WORDS))
            cuts = [part * (k + 1) // parts for part in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                first = places[a]
                for place in places[a:b]:
                    entries.setdefault(size, []).append((int(codes[place]), len(index.segments), place - first))
                index.segments.append((number, first, places[b] if b <= k else len(ids)))
        for size, rows in entries.items():
            rows.sort()
            code = np.array([r[0] for r in rows], np.uint64)
            unique, first = np.unique(code, return_index=True)
            ends = np.append(first[1:], len(rows))
            owners = np.array([(r[1], r[2]) for r in rows], np.int64).reshape(-1, 2)
            index.pieces[size] = (unique, first, ends, owners)
        return index

    def embedded(self, segment: int, repeat: int) -> np.ndarray:
        """The walk over a segment at the places sampled."""
        key = (segment, repeat)
        if key not in self._embedded:
            item, first, end = self.segments[segment]
            places = sampled_places(WALK * (end - first), repeat)
            self._embedded[key] = embed(self.items[item][None, first:end], int(places[-1]) + 1, repeat)[0, places]
        return self._embedded[key]


def _codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A code for every run of ``size`` ids."""
    n = len(ids) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        out = out * _BASE + _mix(ids[i : i + n].astype(np.uint64) + np.uint64(1))
    return out


def _windows(index: Index, ids: np.ndarray) -> np.ndarray:
    """Distinct (segment, start) of the windows that a piece of the segment puts there; ``ids`` holds texts parted by zeros."""
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    found = []
    for size, (codes, first, ends, owners) in index.pieces.items():
        if len(ids) < size:
            continue
        at = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(at):
            continue
        code = np.zeros(len(at), np.uint64)
        for i in range(size):
            code = code * _BASE + _mix(ids[at + i].astype(np.uint64) + np.uint64(1))
        slot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[slot] == code
        at, slot = at[hit], slot[hit]
        times = ends[slot] - first[slot]
        row = np.repeat(first[slot] - np.cumsum(times) + times, times) + np.arange(times.sum())
        found.append(np.stack([owners[row, 0], np.repeat(at, times) - owners[row, 1]], axis=1))
    if not found:
        return np.empty((0, 2), np.int64)
    return np.unique(np.concatenate(found), axis=0)


def find(index: Index, texts: Iterable[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, last word after the run, edits, words of the item): the best run of each leak."""
    get = index.vocabulary.get
    out: list[tuple[int, int, int, int, int]] = []
    part: list[np.ndarray] = []
    where: list[int] = []
    size = 0
    margin = max(map(len, index.items), default=0) * 2 + 2
    gap = np.zeros(margin, np.int64)

    def flush() -> None:
        nonlocal part, where, size
        if part:
            begin = np.cumsum([margin] + [len(p) + margin for p in part])[:-1]
            ids = np.concatenate([gap, *[x for p in part for x in (p, gap)]])
            out.extend((where[t], *rest) for t, *rest in _leaks(index, ids, begin))
        part, where, size = [], [], 0

    for number, text in enumerate(texts):
        words = plain_words(text)
        if words:
            part.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
            where.append(number)
            size += len(words) + margin
            if size >= _WORDS_AT_ONCE:
                flush()
    flush()
    return out


def _leaks(index: Index, ids: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    windows = _windows(index, ids)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    runs = np.flatnonzero(np.diff(windows[:, 0], prepend=-1)).tolist()
    cuts = sorted({*runs, *range(0, len(windows), _WINDOWS_AT_ONCE), len(windows)})
    found = []  # item, start of the item
    for a, b in zip(cuts, cuts[1:], strict=False):  # windows of one segment
        segment = int(windows[a, 0])
        item, first, end = index.segments[segment]
        start = windows[a:b, 1]
        rows = ids[start[:, None] + np.arange(end - first)]
        near = np.zeros(len(start), bool)
        for repeat in range(REPEATS):
            left = np.flatnonzero(~near)
            if not len(left):
                break
            places = sampled_places(WALK * (end - first), repeat)
            walk = embed(rows[left], int(places[-1]) + 1, repeat)[:, places]
            near[left] = (walk == index.embedded(segment, repeat)).all(axis=1)
        found.append(np.stack([np.full(near.sum(), item), start[near] - first], axis=1))
    near_items = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
    for item in np.unique(near_items[:, 0]).tolist():
        words, k = index.items[item], index.edits[item]
        n = len(words)
        starts = near_items[near_items[:, 0] == item, 1]
        step = max(1, _CELLS_AT_ONCE // (n + 2 * k))
        for a in range(0, len(starts), step):
            low = starts[a : a + step] - k  # other runs of the text may start up to k words off
            edits, end = edit_distances(words, ids[low[:, None] + np.arange(n + 2 * k)])
            for begins, d, e in zip(low[edits <= k], edits[edits <= k], end[edits <= k], strict=True):
                last = int(begins + e)
                text = int(np.searchsorted(begin, last, side="left") - 1)
                rank = (int(d), last - int(begin[text]))
                if rank < best.get((text, item), (1 << 60, 0)):
                    best[text, item] = rank
    return [(t, i, last, d, len(index.items[i])) for (t, i), (d, last) in sorted(best.items())]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row (doc_id, item_id, end_word, edits, item_words, similarity) per row of ``docs`` and leaked item.

    ``end_word`` is the word after the best run, the earliest of the best. Null and empty texts and items without words leak nothing; items
    that repeat are each reported; null ids keep their rows; other columns are not looked at. The benchmark's distinct texts are
    looked up in blocks of bounded size, and the item ids joined to what leaks.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = None
    for column in leak_columns("text", benchmark, item_text, similarity):
        part = rows.select("doc_id", F.explode(column).alias("leak")).select("doc_id", "leak.*")
        found = part if found is None else found.unionByName(part)
    ids = benchmark.select(F.sha2(utf8(item_text), 256).alias("item_key"), F.col(f"`{item_id}`").cast("long").alias("item_id"))
    return found.join(ids, "item_key").select("doc_id", "item_id", "end_word", "edits", "item_words", "similarity")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item; ``item_id`` is not looked at."""
    mark = unique_prefix(docs, "_leaks")
    for column in leak_columns(text, benchmark, item_text, similarity):
        docs = docs.withColumn(mark, column).where(F.size(mark) == 0).drop(mark)
    return docs


def leak_columns(text: str, benchmark: DataFrame, item_text: str = "text", similarity: float = SIMILARITY) -> list[Column]:
    """One column per block of the benchmark's distinct texts: the leaks of these in a text column, by the texts' SHA-256."""
    texts = benchmark.select(utf8(item_text).alias("text")).where(F.octet_length("text") > 0).distinct()
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / 6 / BLOCK_WORDS))
    parts = (texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("text") for b in range(blocks))
    keyed = (part.select("text", F.sha2("text", 256).alias("key")) for part in parts)
    return [_lookup(benchmark.sparkSession, text, part.collect(), similarity) for part in keyed]  # one block at a time


_LEAK = "array<struct<item_key:string,end_word:long,edits:long,item_words:long,similarity:double>>"


def _lookup(spark: SparkSession, text: str, rows: list, similarity: float) -> Column:
    shared = spark.sparkContext.broadcast([(bytes(r["text"]), r["key"]) for r in rows])  # one block, bounded by BLOCK_WORDS
    name = uuid.uuid4().hex
    kind = pa.list_(pa.struct([
        ("item_key", pa.string()), ("end_word", pa.int64()), ("edits", pa.int64()), ("item_words", pa.int64()), ("similarity", pa.float64()),
    ]))

    @F.arrow_udf(_LEAK)
    def run(batch: pa.Array) -> pa.Array:
        held = shared.value
        index = _index_of(name, held, similarity)
        out: list[list[dict]] = [[] for _ in range(len(batch))]
        for t, i, last, d, n in find(index, (text.as_py() for text in batch)):
            out[t].append({"item_key": held[i][1], "end_word": last, "edits": d, "item_words": n, "similarity": 1 - d / n})
        release_memory()
        return pa.array(out, kind)

    return run(utf8(text))


_INDEXES: dict[tuple[str, float], Index] = {}


def _index_of(key: str, held: list, similarity: float) -> Index:
    """The index of a block, built once per worker."""
    if (key, similarity) not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key, similarity] = Index.of([text for text, _ in held], similarity)
    return _INDEXES[key, similarity]
