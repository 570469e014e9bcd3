"""Language identification: script ranges, word scores, Viterbi with a switching penalty.

A word's script, told by its first byte's range, narrows the languages to those
that use the script. Byte trigrams score the word in each of them; Viterbi over the words of a text, where
a change of language costs a penalty, labels its spans. The text's language holds the most letters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import crc_of_id, release_memory, struct_array, unique_prefix

#: Expected number of distinct texts per language that the trigram model is fitted on.
SAMPLE_PER_LANGUAGE = 2000
BUCKETS = 1 << 16
SWITCH_PENALTY = 6.0
LEAST_SHARE = 0.5
_FOREIGN = -20.0
#: Characters that are scored at once, and that are decoded at once.
_TEXT_AT_ONCE, _DECODED_AT_ONCE = 1 << 18, 1 << 21

#: Script of a word by the first byte of its UTF-8 form: ranges of lead bytes.
SCRIPTS = (
    (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xC9, 1), (0xCE, 0xCF, 2), (0xD0, 0xD3, 3), (0xD4, 0xD5, 4),
    (0xD6, 0xD7, 5), (0xD8, 0xDB, 6), (0xE0, 0xE0, 7), (0xE1, 0xE1, 8), (0xE3, 0xE3, 9), (0xE4, 0xE9, 10), (0xEA, 0xED, 11),
)
_SCRIPT_OF = np.zeros(256, np.int8)
for _first, _last, _script in SCRIPTS:
    _SCRIPT_OF[_first : _last + 1] = _script
N_SCRIPTS = 12
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # bucket x language: log-probability, the mean over languages taken off
    allowed: np.ndarray  # script x language


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket per letter byte, first gram of each word, script, letter bytes and text index of each word)."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    letters = _LETTER[raw]
    clean = np.where(letters, raw, 32).astype(np.uint32)
    at = np.flatnonzero(letters)
    code = (clean[at - 1] << 16) | (clean[at] << 8) | clean[at + 1]
    bucket = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    starts = ~letters[at - 1]
    first = np.flatnonzero(starts)
    begin = np.cumsum([1] + [len(d) + 1 for d in data])
    text = np.searchsorted(begin, at[first], side="right") - 1
    size = np.diff(np.append(first, len(at)))
    return bucket, first, _SCRIPT_OF[raw[at[first]]], size, text


def word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words x languages scores, letter bytes, text index) of all words of some texts."""
    bucket, first, script, size, text = grams_of(texts)
    if not len(first):
        return np.zeros((0, len(model.languages)), np.float32), size, text
    scores = np.add.reduceat(model.scores[bucket], first, axis=0)
    fits = model.allowed[script]
    narrowed = fits.any(axis=1)
    scores[~narrowed] = 0
    scores += np.where(fits | ~narrowed[:, None], 0, _FOREIGN).astype(np.float32)
    return scores, size, text


def viterbi(scores: np.ndarray, start: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; all texts advance together, word by word, the longest first."""
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    n_lang = scores.shape[1]
    kind = np.int16 if n_lang < 1 << 15 else np.int32
    out = np.zeros(len(scores), kind)
    most = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(most), side="left")
    back = np.zeros((len(scores), n_lang), kind)
    value = np.zeros((len(count), n_lang), np.float32)
    own = np.arange(n_lang, dtype=kind)
    for t in range(most):
        k = active[t]
        rows = start[:k] + t
        v = value[:k]
        if t:
            best = v.argmax(axis=1)
            jump = v[np.arange(k), best][:, None] - penalty
            stay = v >= jump
            back[rows] = np.where(stay, own, best[:, None].astype(kind))
            v = np.where(stay, v, jump)
            v = v - v.max(axis=1, keepdims=True)
        value[:k] = v + scores[rows]
    state = value.argmax(axis=1).astype(kind)
    for t in range(most - 1, -1, -1):
        k = active[t]
        rows = start[:k] + t
        out[rows] = state[:k]
        if t:
            state[:k] = back[rows, state[:k]]
    return out


def spans(model: Model, text: str, penalty: float = SWITCH_PENALTY) -> list[tuple[str, int, int]]:
    """(language, first word, word after the last) of each span of one text."""
    scores, _, _ = word_scores(model, [text])
    if not len(scores):
        return []
    labels = viterbi(scores, np.array([0]), np.array([len(scores)]), penalty)
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [(model.languages[labels[a]], a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _batches(texts: Iterable[str], most: int = _TEXT_AT_ONCE) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def predict(model: Model, texts: Iterable[str | None], penalty: float = SWITCH_PENALTY) -> tuple[list[str], list[float]]:
    """Language and its share of the letters; ``und`` and 0 without a letter or without a model."""
    names: list[str] = []
    shares: list[float] = []
    for part in _batches((t or "" for t in texts), _DECODED_AT_ONCE):
        n = len(part)
        if not model.languages:
            names += ["und"] * n
            shares += [0.0] * n
            continue
        scored, before = [], 0
        for some in _batches(part):
            scores, size, text = word_scores(model, some)
            scored.append((scores, size, text + before))
            before += len(some)
        scores, size, text = (np.concatenate(column) for column in zip(*scored, strict=True))
        count = np.bincount(text, minlength=n)
        start = np.cumsum(count) - count
        labels = viterbi(scores, start, count, penalty)
        width = len(model.languages)
        held = np.bincount(text * width + labels, weights=size, minlength=n * width).reshape(n, width)
        best = held.argmax(axis=1)
        total = held.sum(axis=1)
        for i, t in enumerate(part):
            if total[i] and (t.isascii() or any(map(str.isalpha, t))):
                names.append(model.languages[best[i]])
                shares.append(float(held[i, best[i]] / total[i]))
            else:
                names.append("und")
                shares.append(0.0)
    return names, shares


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fits trigram scores and script use on about SAMPLE_PER_LANGUAGE distinct texts of every language.

    Learns only from rows with a language whose crc32 of the id mod 3 is not 1. Texts are chosen by a
    hash, and one that repeats teaches once; a language with fewer texts gives all of them.
    """
    rows = docs.where(F.col(f"`{lang}`").isNotNull() & (crc_of_id(doc_id) % 3 != 1)).select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    # hashes of the texts are counted, not sent with them
    hashed = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    found = hashed.groupBy("lang").agg(F.count("*").alias("n")).collect()
    names = sorted(r["lang"] for r in found)
    if not names:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    shares = [(r["lang"], min(1.0, SAMPLE_PER_LANGUAGE / r["n"]) * 1_000_003) for r in found]
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, below double"))
    chosen = rows.join(share, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("below")).select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                total = grams.setdefault(name, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for part in _batches(texts):
                    bucket, _, script, _, _ = grams_of(part)
                    total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script, minlength=N_SCRIPTS)
        for name, total in grams.items():
            at = np.flatnonzero(total)
            yield pa.record_batch({"lang": pa.array([name] * len(at)), "at": pa.array(at), "n": pa.array(total[at])})

    # at most BUCKETS + N_SCRIPTS counts per language
    counted = chosen.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    counts = np.zeros((BUCKETS + N_SCRIPTS, len(names)))
    place = {n: i for i, n in enumerate(names)}
    for r in counted.groupBy("lang").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n")).toLocalIterator():
        counts[np.array(r["at"]), place[r["lang"]]] = r["n"]
    smooth = counts[:BUCKETS] + 0.5
    logs = np.log(smooth / smooth.sum(axis=0))
    scripts = counts[BUCKETS:]
    allowed = scripts >= np.maximum(1, 0.01 * scripts.sum(axis=0))
    return Model(tuple(names), (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), allowed)


def prediction(text: str, model: Model) -> Column:
    """struct(lang, score) of a text column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        names, shares = predict(model, (t.as_py() for t in texts))
        release_memory()
        return struct_array(["lang", "score"], [pa.array(names, pa.string()), pa.array(shares, pa.float64())])

    return run(F.col(f"`{text}`"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which one language holds LEAST_SHARE of the letters."""
    mark = unique_prefix(docs, "_language")
    found = docs.withColumn(mark, prediction(text, train(docs, text, lang, doc_id)))
    return found.where((F.col(mark)["lang"] != "und") & (F.col(mark)["score"] >= LEAST_SHARE)).drop(mark)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when no row has a language
    to learn from. Ties go to the language first in the alphabet. Null ids and repeated rows keep their row; an
    empty table gives an empty result; other columns are not looked at.
    """
    model = train(docs, text, lang, doc_id)
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (crc_of_id(doc_id) % 3 == 1).alias("held_out"),
        prediction(text, model).alias("_p"),
    ).select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
