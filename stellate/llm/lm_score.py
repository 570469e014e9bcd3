"""Stupid-backoff scores of documents under the corpus' own n-gram counts.

Documents are taken in blocks of about BLOCK_WORDS words. A block lists each of its n-grams once, with its number
there, packed into one row per hash bucket. Buckets sum the lists of all blocks and answer each with the corpus counts;
a block joins the answers to its n-grams and sums per document. So an n-gram that a third of the corpus
repeats is one entry per block, an entry of a sorted list takes about six bytes, and no list of the corpus'
n-grams is ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stellate.llm.common import plain_words, utf8
from stellate.session import cut_lineage

BACKOFF, LEAST_COUNT = 0.4, 2
BLOCK_WORDS, BUCKET_GRAMS = 1 << 20, 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)

def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: the small ones' upper bytes take no room."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


class Block:
    """Some documents as numbers of their distinct words, which are kept as hashes."""

    def __init__(self, ids: list, lengths: np.ndarray, word: np.ndarray, hashes: np.ndarray) -> None:
        self.ids, self.lengths, self.word, self.hashes = ids, lengths, word, hashes

    @classmethod
    def of(cls, ids: list, texts: list[list[bytes]]) -> Block:
        lengths = np.array([len(t) for t in texts], np.int64)
        local: dict[bytes, int] = {}
        word = np.fromiter((local.setdefault(w, len(local)) for t in texts for w in t), np.int64, int(lengths.sum()))
        return cls(ids, lengths, word, np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local)))

    def key(self) -> int:
        """Tells whether two readings of the documents made the same block."""
        digest = xxhash.xxh64(self.word.tobytes())
        digest.update(self.hashes.tobytes())
        return digest.intdigest() - (1 << 63)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, times) of the distinct words and bigrams by rising hash, and where each position's are.

        A position without a word before it in its document has no bigram; it points anywhere.
        """
        n = max(1, len(self.hashes))
        follows = np.ones(len(self.word), bool)
        follows[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = False
        at = np.flatnonzero(follows)
        pair, number = np.unique(self.word[at - 1] * n + self.word[at], return_inverse=True)
        first, second = np.divmod(pair, n)
        mixed = (self.hashes[first] ^ (self.hashes[first] >> np.uint64(29))) * _BASE + self.hashes[second]
        grams = np.concatenate([self.hashes, mixed])
        times = np.concatenate([np.bincount(self.word, minlength=len(self.hashes)), np.bincount(number, minlength=len(pair))])
        order = np.argsort(grams, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.zeros(len(self.word), np.int64)
        pairs[at] = place[len(self.hashes) :][number]
        return grams[order], times[order], place[: len(self.hashes)][self.word], pairs


def _blocks(make: Callable[[int, int, Block], Iterator[pa.RecordBatch]]):
    """Runs ``make(partition, number, block)`` over the documents of each partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, number = [], [], 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = plain_words(text.as_py())
                ids.append(doc)
                texts.append(words)
                size += len(words) + 1
                if size >= BLOCK_WORDS:
                    yield from make(part, number, Block.of(ids, texts))
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield from make(part, number, Block.of(ids, texts))

    return run


_LISTS = "bucket long, part int, number int, key long, grams binary, times binary"
_ROWS = "part int, number int, key long, bucket long, counts binary, ids binary, lengths binary, words binary, hashes binary"


def _lists(bits: int):
    def make(part: int, number: int, block: Block) -> Iterator[pa.RecordBatch]:
        grams, times, _, _ = block.grams()
        bucket = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        spans = list(zip(starts, [*starts[1:], len(bucket)], strict=False)) if starts else []
        yield pa.record_batch({
            "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
            "part": pa.array([part] * len(spans), pa.int32()),
            "number": pa.array([number] * len(spans), pa.int32()),
            "key": pa.array([block.key()] * len(spans), pa.int64()),
            "grams": pa.array([packed(np.diff(grams[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
            "times": pa.array([packed(times[a:b]) for a, b in spans], pa.binary()),
        })

    return make


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts for the lists of each bucket; rows come sorted by bucket."""
    held: list[dict] = []

    def done() -> pa.RecordBatch:
        lists = [np.cumsum(unpacked(r["grams"]), dtype=np.uint64) for r in held]
        times = np.concatenate([unpacked(r["times"]) for r in held]).astype(np.int64)
        grams, number = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.zeros(len(grams), np.int64)
        np.add.at(total, number, times)
        answers = np.split(total[number], np.cumsum([len(x) for x in lists])[:-1])
        return pa.record_batch({
            "part": pa.array([r["part"] for r in held], pa.int32()),
            "number": pa.array([r["number"] for r in held], pa.int32()),
            "key": pa.array([r["key"] for r in held], pa.int64()),
            "bucket": pa.array([r["bucket"] for r in held], pa.int64()),
            "counts": pa.array([packed(x) for x in answers], pa.binary()),
            **{c: pa.array([None] * len(held), pa.binary()) for c in ("ids", "lengths", "words", "hashes")},
        })

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if held and held[0]["bucket"] != row["bucket"]:
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


def _documents(part: int, number: int, block: Block) -> Iterator[pa.RecordBatch]:
    column = pa.record_batch({"id": pa.array(block.ids)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, column.schema) as out:
        out.write_batch(column)
    yield pa.record_batch({
        "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "key": pa.array([block.key()], pa.int64()),
        "bucket": pa.array([-1], pa.int64()), "counts": pa.array([None], pa.binary()),
        "ids": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "lengths": pa.array([packed(block.lengths)], pa.binary()),
        "words": pa.array([packed(block.word)], pa.binary()), "hashes": pa.array([block.hashes.tobytes()], pa.binary()),
    })


def _score(id_type: pa.DataType):
    """Sums per document; a block's own row comes first, then its answers by bucket."""

    def finish(own: dict, answers: list[bytes]) -> pa.RecordBatch:
        lengths, numbers = unpacked(own["lengths"]).astype(np.int64), unpacked(own["words"]).astype(np.int64)
        _, _, words, pairs = Block([], lengths, numbers, np.frombuffer(own["hashes"], np.uint64)).grams()
        counts = np.concatenate([unpacked(a) for a in answers]) if answers else np.zeros(0)
        logs = np.log(counts.astype(np.float64))
        starts = np.cumsum(lengths) - lengths
        first = np.zeros(len(words), bool)
        first[starts[lengths > 0]] = True
        word = logs[words]
        context = np.concatenate([[0.0], word[:-1]]) if len(word) else word
        pair = np.where(first, -1.0, logs[pairs]) if len(word) else word
        seen = pair >= math.log(LEAST_COUNT) - 1e-9
        value = np.where(seen, pair - context, word + np.where(first, 0.0, math.log(BACKOFF)))
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])[starts + lengths] - np.concatenate([[0], np.cumsum(x)])[starts]
        doc = pa.ipc.open_stream(own["ids"]).read_next_batch().column(0)
        return pa.record_batch({
            "doc_id": doc.cast(id_type), "n_words": pa.array(lengths), "log_sum": pa.array(sums(value)),
            "n_backoff": pa.array(sums((~seen).astype(np.int64))),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict | None = None
        answers: list[bytes] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["bucket"] < 0:
                    if own is not None:
                        yield finish(own, answers)
                    own, answers = row, []
                    continue
                if own is None or (own["part"], own["number"], own["key"]) != (row["part"], row["number"], row["key"]):
                    raise RuntimeError("the documents were read in another order the second time")
                answers.append(row["counts"])
        if own is not None:
            yield finish(own, answers)

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_backoff, log_score, score.

    A word scores count(previous word, word) / count(previous word) if the corpus has the pair LEAST_COUNT times or more,
    else BACKOFF x count(word) / words of the corpus; the first word of a text scores the latter without BACKOFF.
    ``log_score`` sums the logarithms and ``score`` is their mean. Null and empty texts have 0 for both. Null ids and
    repeated rows keep their row; an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / 4 / BUCKET_GRAMS))))
    lists = rows.mapInArrow(_blocks(_lists(bits)), _LISTS).repartition("bucket").sortWithinPartitions("bucket")
    answers = lists.mapInArrow(_answer, _ROWS)
    own = rows.mapInArrow(_blocks(_documents), _ROWS)
    met = own.unionByName(answers).repartition("part", "number").sortWithinPartitions("part", "number", "bucket")
    kind = dict(rows.dtypes)["doc_id"]
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    sums = cut_lineage(met.mapInArrow(_score(id_type), f"doc_id {kind}, n_words long, log_sum double, n_backoff long"))
    firsts = F.when(F.col("n_words") > 0, 1).otherwise(0)
    words = sums.agg(F.sum("n_words").alias("n")).first()["n"] or 1
    total = F.col("log_sum") - F.col("n_backoff") * math.log(words)
    return sums.select(
        "doc_id", "n_words", (F.col("n_backoff") - firsts).cast("long").alias("n_backoff"), total.alias("log_score"),
        F.when(F.col("n_words") > 0, total / F.col("n_words")).otherwise(0.0).alias("score"),
    )
