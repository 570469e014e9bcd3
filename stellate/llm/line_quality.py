"""Line labelling with a linear-chain conditional random field.

Every line that has a word gets a feature vector; Viterbi decoding over the
lines of a text marks each as content or boilerplate. A text is kept if content lines hold
at least half of its words. The field's weights are fitted here on a bounded sample of labelled
texts, whose lines carry the label of their text; they are put together, good and bad, so that states change in a chain.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import release_memory, struct_array, unique_prefix, utf8

#: Bounds of the fitting sample; nothing else is bounded.
SAMPLE_DOCS, SAMPLE_LINES, MIXED_LINES = 2000, 200, 60
LEAST_WORDS, MOST_REPEATED = 50, 50  # words, and percent of words in repeated windows
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT, _STOP, _BANG = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?"
FEATURES = 10


def _share(line: bytes, chars: bytes) -> float:
    return (len(line) - len(line.translate(None, chars))) / max(1, len(line))


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[float]:
    n = len(words)
    return [
        1.0,
        math.log1p(n),
        len(b"".join(words)) / n / 8,
        min(1.0, 8 * _share(line, SYMBOLS)),
        _share(line, _UPPER),
        _share(line, _DIGIT),
        min(1.0, 8 * _share(line, _BANG)),
        min(1.0, 8 * _share(line, _STOP)),
        len(set(words)) / n,
        float(repeated),
    ]


def lines_of(text: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of them equal an earlier line."""
    seen: set[bytes] = set()
    features, sizes, repeats = [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        features.append(line_features(line, words, again))
        sizes.append(len(words))
    return features, sizes, repeats


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside a window of ``window`` words that occurs twice or more, its first place included."""
    if len(words) < window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids
    for _ in range(window - 1):  # number pairs, then triples, so that codes never overflow
        pairs = code[:-1] * len(number) + ids[len(ids) - len(code) + 1 :]
        code = np.unique(pairs, return_inverse=True)[1]
    often = (np.bincount(code) > 1)[code]
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + window, -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best state of each line (1 is content); on equal scores content."""
    a, b = 0.0, 0.0
    back = np.zeros((len(scores), 2), np.int8)
    (m00, m01), (m10, m11) = moves.tolist()
    for i, (s0, s1) in enumerate(scores.tolist()):
        if i:
            to0, to1 = (a + m00, b + m10), (a + m01, b + m11)
            back[i] = to0[1] >= to0[0], to1[1] >= to1[0]
            a, b = max(to0), max(to1)
        a, b = a + s0, b + s1
    state = int(b >= a)
    out = np.zeros(len(scores), np.int8)
    for i in range(len(scores) - 1, -1, -1):
        out[i] = state
        state = back[i, state]
    return out


def chains_of(texts: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, state of each line) to fit on: two good and two bad texts in a row, in turns in either order, of each the first
    MIXED_LINES lines, so that the field sees what changes of state look like; what is left over of one label stays alone."""
    by = [[x for x, y in texts if y == s and len(x)] for s in (0, 1)]
    fours = min(map(len, by)) // 2
    out = [(x, np.full(len(x), s, np.int8)) for s in (0, 1) for x in by[s][2 * fours :]]
    for i in range(fours):
        order = [(1, 2 * i), (0, 2 * i), (1, 2 * i + 1), (0, 2 * i + 1)][:: -1 if i % 2 else 1]
        parts = [(by[s][j][:MIXED_LINES], s) for s, j in order]
        out.append((np.concatenate([x for x, _ in parts]), np.concatenate([np.full(len(x), s, np.int8) for x, s in parts])))
    return out


def fit(texts: list[tuple[np.ndarray, int]], rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2 x features) and transition scores (2 x 2) by gradient ascent on the log-likelihood of ``chains_of`` the texts.

    All chains advance together, line by line. Without both labels the weights are zero, which keeps everything.
    """
    weights, moves = np.zeros((2, FEATURES)), np.zeros((2, 2))
    if len({y for x, y in texts if len(x)}) < 2:
        return weights, moves
    chains = sorted(chains_of(texts), key=lambda c: -len(c[0]))
    lengths = np.array([len(x) for x, _ in chains])
    n, most = len(chains), int(lengths.max())
    feats = np.zeros((most, n, FEATURES))
    gold_w, gold_m = np.zeros_like(weights), np.zeros_like(moves)
    for j, (x, y) in enumerate(chains):
        feats[: len(x), j] = x
        for s in (0, 1):
            gold_w[s] += x[y == s].sum(axis=0)
        np.add.at(gold_m, (y[:-1], y[1:]), 1)
    active = [int((lengths > t).sum()) for t in range(most)]
    total = lengths.sum()
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for r in range(1, rounds + 1):
        score = feats @ weights.T
        step = np.exp(moves - moves.max())
        alpha, beta = np.zeros((most, n, 2)), np.zeros((most, n, 2))
        for t in range(most):
            k = active[t]
            prior = np.ones((k, 2)) if t == 0 else alpha[t - 1, :k] @ step
            a = prior * np.exp(score[t, :k] - score[t, :k].max(axis=1, keepdims=True))
            alpha[t, :k] = a / a.sum(axis=1, keepdims=True)
        sum_w, sum_m = np.zeros_like(weights), np.zeros_like(moves)
        for t in range(most - 1, -1, -1):
            k, later = active[t], active[t + 1] if t + 1 < most else 0
            b = np.ones((k, 2))
            if later:
                e = np.exp(score[t + 1, :later] - score[t + 1, :later].max(axis=1, keepdims=True)) * beta[t + 1, :later]
                both = alpha[t, :later, :, None] * step * e[:, None, :]
                sum_m += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                b[:later] = e @ step.T
            beta[t, :k] = b / b.sum(axis=1, keepdims=True)
            p = alpha[t, :k] * beta[t, :k]
            sum_w += (p / p.sum(axis=1, keepdims=True)).T @ feats[t, :k]
        grads = [(gold_w - sum_w) / total - 1e-3 * weights, (gold_m - sum_m) / total - 1e-3 * moves]
        for value, g, m1, m2 in zip((weights, moves), grads, first, second, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            value += 0.05 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return weights, moves


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Fits the field on at most SAMPLE_DOCS labelled texts, chosen by a hash of their id; of an id that repeats, on one text."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_DOCS)
        .select(F.col("doc_id").alias("_labelled"), "_quality")
    )

    @F.arrow_udf("array<array<double>>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([lines_of(t)[0][:SAMPLE_LINES] for t in texts.to_pylist()], pa.list_(pa.list_(pa.float64())))

    # the sample's size is bounded by its parameters
    rows = (
        docs.join(F.broadcast(chosen), F.col(f"`{doc_id}`") == F.col("_labelled"))
        .select(features(utf8(text)).alias("x"), F.col("_quality").alias("y"), F.col("_labelled").alias("id"))
        .groupBy("id", "y")
        .agg(F.min("x").alias("x"))
        .select("x", "y", F.xxhash64("id").alias("h"))
        .collect()
    )
    rows.sort(key=lambda r: (r.h, r.x))
    return fit([(np.array(r.x).reshape(-1, FEATURES), int(r.y)) for r in rows])


def assess(text: bytes, weights: np.ndarray, moves: np.ndarray) -> tuple[int, int, int, int, int, float]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content share)."""
    words = text.split()
    features, sizes, repeats = lines_of(text)
    share = 0.0
    if words:
        states = viterbi(np.array(features) @ weights.T, moves)
        share = float(np.dot(states, sizes) / len(words))
    return (
        len(words),
        len(b"".join(words).decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        repeats,
        repeated_words(words),
        share,
    )


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share"]
_VERDICT = (
    "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,content_share:double>"
)


def verdict(text: str, weights: np.ndarray, moves: np.ndarray) -> Column:
    """The statistics and content share of a text column as one struct; null counts as empty."""

    @F.arrow_udf(_VERDICT)
    def run(texts: pa.Array) -> pa.Array:
        rows = [assess(t.as_py(), weights, moves) for t in texts]
        release_memory()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
        kinds = [pa.int64()] * 5 + [pa.float64()]
        return struct_array(_NAMES, [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)])

    return run(utf8(text))


def base_failed(v: Column) -> Column:
    return (v["n_words"] < LEAST_WORDS) | (100 * v["n_repeat_words"] > MOST_REPEATED * v["n_words"])


def kept(v: Column) -> Column:
    """Base rules passed and at least half of the words in content lines."""
    return ~base_failed(v) & (v["content_share"] >= CONTENT_SHARE)


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    mark = unique_prefix(docs, "_verdict")
    verdicts = docs.withColumn(mark, verdict(text, *train(docs, labels, doc_id, text)))
    return verdicts.where(kept(F.col(mark))).drop(mark)


def assess_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, statistics, ``base_failed``, ``content_share`` and ``kept``.

    Null and empty texts have no words and fail. Repeated rows stay, null ids keep their row, an empty table
    gives an empty result, and other columns are not looked at.
    """
    weights, moves = train(docs, labels, doc_id, text)
    v = F.col("_v")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), verdict(text, weights, moves).alias("_v")).select(
        "doc_id",
        *[v[n].alias(n) for n in _NAMES[:5]],
        base_failed(v).alias("base_failed"),
        kept(v).alias("kept"),
        v["content_share"].alias("content_share"),
    )
