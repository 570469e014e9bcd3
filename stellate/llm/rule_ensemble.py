"""Quality classifier: a sparse ensemble of conjunctive rules.

Shallow boosted trees are grown over text statistics; every path from a root is a rule, a conjunction of
comparisons. A logistic model with an L1 penalty gives each rule a weight, most of them zero. What is left is
compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import crc_of_id, utf8

#: Most labelled texts that the model is fitted on; nothing else is bounded.
SAMPLE_DOCS = 8000
TREES, DEPTH, PENALTY = 24, 3, 0.002
THRESHOLD = 0.3
STATISTICS = (
    "words", "word_bytes", "symbols", "upper", "digits", "bangs", "stops", "distinct", "repeated_lines", "line_words",
    "links", "longest",
)
_SYMBOLS, _UPPER = b"#*$%&|<>@_=+{}[]\\^~", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS, _BANGS, _STOPS = b"0123456789", b"!?", b".,;:"


def statistics_of(text: bytes) -> list[float]:
    """The statistics of one text, all zero without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    count = lambda chars: size - len(text.translate(None, chars))
    return [
        math.log1p(n),
        sum(map(len, words)) / n,
        count(_SYMBOLS) / n,
        count(_UPPER) / size,
        count(_DIGITS) / size,
        count(_BANGS) / n,
        count(_STOPS) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        (text.count(b"http") + text.count(b"www.")) / n,
        math.log1p(max(map(len, words))),
    ]


def statistics(text: str) -> Column:
    """The statistics of a text column as an array; null counts as empty."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics_of(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return run(utf8(text))


#: A comparison: statistic, True for "at most", bound. A rule is a set of them.
Rule = frozenset[tuple[int, bool, float]]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at, low, bound in rule:
        out &= (x[:, at] <= bound) if low else (x[:, at] > bound)
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, depth: int, out: list[Rule], step: np.ndarray) -> None:
    """One regression tree on gradients; ``step`` gets the leaves' values, ``out`` every path."""
    total_g, total_h = g[rows].sum(), h[rows].sum() + 1.0
    best = (1e-3, -1, 0.0)
    if depth:
        for at, bounds in enumerate(cuts):
            if not len(bounds):
                continue
            cell = np.searchsorted(bounds, x[rows, at], side="left")  # cell <= i means x <= bounds[i]
            left_g = np.cumsum(np.bincount(cell, g[rows], len(bounds) + 1))[:-1]
            left_h = np.cumsum(np.bincount(cell, h[rows], len(bounds) + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h) - total_g**2 / total_h
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), at, float(bounds[i]))
    if best[1] < 0:
        step[rows] = total_g / total_h
        return
    _, at, bound = best
    low = x[rows, at] <= bound
    for side, mine in ((True, rows[low]), (False, rows[~low])):
        rule = path | {(at, side, bound)}
        out.append(rule)
        _grow(x, g, h, cuts, mine, rule, depth - 1, out, step)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each once, in the order found; half of the rows, dealt in turn, grow each tree."""
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    order = np.random.default_rng(7).permutation(len(y))
    margin = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[Rule, None] = {}
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        out: list[Rule] = []
        step = np.zeros(len(y))
        rows = np.sort(order[tree % 2 :: 2])
        _grow(x, y - p, p * (1 - p), cuts, rows, frozenset(), DEPTH, out, step)
        found.update(dict.fromkeys(out))
        margin += 0.5 * step
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic model, by accelerated proximal gradient."""
    n, k = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    rate = 4 * n / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w, v, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    w[0] = v[0] = math.log((y.sum() + 1) / (n - y.sum() + 1))
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / n
        new = v - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as one expression over the statistics array."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            tests = [stats[at] <= bound if low else stats[at] > bound for at, low, bound in sorted(rule)]
            condition = tests[0]
            for test in tests[1:]:
                condition = condition & test
            margin = margin + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Without both labels there are no rules, and the score is the labels' smoothed mean."""
    ones = float(y.sum())
    base = math.log((ones + 1) / (len(y) - ones + 1))
    if len(y) == 0 or ones in (0, len(y)):
        return Ensemble(base, ())
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble(base, ())
    z = np.array([covers(r, x) for r in rules], float).T
    intercept, weights = lasso(z, y, PENALTY)
    return Ensemble(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Ensemble:
    """Fits on at most SAMPLE_DOCS labelled ids whose crc32 of the id mod 5 is not 0, chosen by a hash of the id.

    Of rows that repeat an id the one with the least statistics teaches; null labels and ids teach nothing.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(crc_of_id("doc_id") % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_DOCS)
        .select(F.col("doc_id").alias("_labelled"), "_quality")
    )
    # the sample's size is bounded by its parameter
    rows = (
        docs.join(F.broadcast(chosen), F.col(f"`{doc_id}`") == F.col("_labelled"))
        .select(statistics(text).alias("x"), F.col("_quality").alias("y"), F.col("_labelled").alias("id"))
        .groupBy("id", "y")
        .agg(F.min("x").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: (r.id, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.y for r in rows], float))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other, from statistics that are all zero. Repeated rows and null ids keep their row;
    an empty table gives an empty result; other columns are not looked at.
    """
    model = train(docs, labels, doc_id, text)
    return (
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), statistics(text).alias("_s"))
        .select("doc_id", (crc_of_id(doc_id) % 5 == 0).alias("held_out"), model.score(F.col("_s")).alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )
