"""Alignment of two tokenizers' outputs by sparse products of token-byte incidence matrices.

Both tokenizers cover the same bytes, so each gives a matrix with one row per token and one column per byte. Row products of
one with the other's transpose list the token pairs that share bytes (Gustavson: a row of the product is the sum of those
rows of the right factor that the left row names). Byte offsets where tokens of both end cut the text into groups; products of
token-group incidence matrices list the pairs that share a group. A batch of texts is one block-diagonal product: as both
cover the same bytes, every text's end is a common offset, and neither links nor groups reach from one text into the next.

The same holds inside a text: a space before a character that isn't white space begins a token for both, so a text's matrices are
block-diagonal over the chunks between such spaces. Chunks repeat, so each distinct chunk is encoded and multiplied once and kept.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from stellate.llm.common import release_memory, utf8
from stellate.llm.tokens import byte_letters
from stellate.session import cut_lineage

#: Bytes of text that one product covers; a longer text is a product of its own.
BATCH_BYTES = 1 << 18
#: Distinct chunks that a worker keeps before it starts afresh.
KEPT_CHUNKS = 150_000
#: Texts with other white space beside a space aren't cut into chunks; nor are those with characters that white space is defined differently for.
_WHOLE = re.compile("[\x1c-\x1f\u180e\ufeff]| \\s| \\Z|\\A\\s")
#: Distinct id pairs up to which their counts are broadcast (about 50 bytes each); beyond, links are shuffled to them.
BROADCAST_PAIRS = 1 << 20
#: Pairs of an output batch of ``links``; a text whose own product is larger comes in several.
PAIRS_AT_ONCE = 1 << 18
_LOW = 0xFFFFFFFF


@dataclass
class Csr:
    """A sparse matrix by rows: row i's columns and values lie at ``indptr[i]`` to ``indptr[i + 1]``, columns rising."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.indptr) - 1

    @classmethod
    def spans(cls, ends: np.ndarray) -> Csr:
        """Row i has ones from the end of row i - 1 up to its own: tokens over bytes."""
        total = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]).astype(np.int64), np.arange(total), np.ones(total, np.int64), total)

    @classmethod
    def one_each(cls, columns: np.ndarray, width: int) -> Csr:
        """Row i has a one in ``columns[i]``: tokens over groups."""
        n = len(columns)
        return cls(np.arange(n + 1), columns, np.ones(n, np.int64), width)

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(self.height), np.diff(self.indptr))
        counts = np.bincount(self.indices, minlength=self.width)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), rows[order], self.data[order], self.height)

    def rows(self, first: int, last: int) -> Csr:
        a, b = self.indptr[first], self.indptr[last]
        return Csr(self.indptr[first : last + 1] - a, self.indices[a:b], self.data[a:b], self.width)

    def times(self, right: Csr) -> Csr:
        """The product, row by row: each entry of a left row brings the right row it names, equal columns are summed."""
        size = right.indptr[self.indices + 1] - right.indptr[self.indices]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first - right.indptr[self.indices], size)
        row = np.repeat(np.repeat(np.arange(self.height), np.diff(self.indptr)), size)
        column = right.indices[at]
        value = np.repeat(self.data, size) * right.data[at]
        key = row * right.width + column
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, row, column, value = key[order], row[order], column[order], value[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(value, start) if len(start) else value
        counts = np.bincount(row[start], minlength=self.height)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), column[start], total, right.width)


@dataclass
class Aligned:
    """Texts of one batch, end to end: their tokens, where each token's bytes end, and what the products say."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray

    def common(self) -> np.ndarray:
        """Byte offsets where tokens of both end."""
        return np.intersect1d(self.a_end, self.b_end, assume_unique=True)

    def overlaps(self) -> Csr:
        """Shared bytes of every pair of tokens that shares any."""
        return Csr.spans(self.a_end).times(Csr.spans(self.b_end).transposed())

    def end_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs whose byte ranges end together; they share their last byte, so they overlap."""
        product = self.overlaps()
        i = np.repeat(np.arange(product.height), np.diff(product.indptr))
        same = self.a_end[i] == self.b_end[product.indices]
        return i[same], product.indices[same]

    def groups(self) -> tuple[Csr, Csr]:
        """Token-group incidence of both sides."""
        ends = self.common()
        return (
            Csr.one_each(np.searchsorted(ends, self.a_end), len(ends)),
            Csr.one_each(np.searchsorted(ends, self.b_end), len(ends)),
        )


class Aligner:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, byte_bpe: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._left = Tokenizer.from_str(byte_bpe)
        self._left.encode_special_tokens = True
        self._right = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.a_bytes = [b""] * self._left.get_vocab_size()
        for entry, i in self._left.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        right = self._right
        self.b_bytes = [
            bytes([int(right.id_to_piece(i)[3:-1], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
            for i in range(right.get_piece_size())
        ]
        self._a_len = np.array([len(x) for x in self.a_bytes])
        self._b_len = np.array([len(x) for x in self.b_bytes])

    def encode(self, raws: list[bytes]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """Texts one by one, and both numbers of tokens; none for empty texts and those that either can't give back byte by byte."""
        texts = [raw.decode("utf-8", "replace") for raw in raws]
        left = self._left.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        right = self._right.encode(texts, num_threads=1) if texts else []
        a_ids, b_ids = [], []
        for raw, one, b in zip(raws, left, right, strict=True):
            a = one.ids
            whole = b" " + raw
            same = raw and whole == b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b))
            a_ids.append(a if same else [])
            b_ids.append(b if same else [])
        none = np.zeros(0, np.int64)
        a = np.concatenate([none, *a_ids]).astype(np.int64)
        b = np.concatenate([none, *b_ids]).astype(np.int64)
        both = Aligned(a, b, np.cumsum(self._a_len[a]), np.cumsum(self._b_len[b]))
        return both, np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])

    def encode_chunks(self, raws: list[bytes]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """The same for chunks: one text of all of them, cut where each begins; one by one if that doesn't come out."""
        text = b" ".join(raws)
        a = np.array(self._left.encode_batch_fast([" " + text.decode()], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self._right.encode(text.decode()), np.int64)
        both = Aligned(a, b, np.cumsum(self._a_len[a]), np.cumsum(self._b_len[b]))
        whole = b" " + text
        ends = np.cumsum([len(r) + 1 for r in raws])
        if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
            to_a, to_b = np.searchsorted(both.a_end, ends), np.searchsorted(both.b_end, ends)
            if (both.a_end[to_a] == ends).all() and (both.b_end[to_b] == ends).all():
                return both, np.diff(to_a + 1, prepend=0), np.diff(to_b + 1, prepend=0)
        return self.encode(raws)


@dataclass
class Summary:
    """What chunks say, one entry each: tokens of both, groups, links, the group text, and the links end to end."""

    counts: np.ndarray  # rows: tokens a, tokens b, groups, links
    groups: list[bytes]
    links: np.ndarray


class Chunks:
    """Distinct chunks and what they say; a chunk that can't be given back byte by byte has -1 tokens."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner = aligner
        n_a, n_b = len(aligner.a_bytes), len(aligner.b_bytes)
        self._a, self._b = n_a, n_b
        marks = [(n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")]
        self._marked = np.array([f"{i}{mark}".encode() for n, mark in marks for i in range(n)], object)
        self._size = np.array([len(x) for x in self._marked])
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.held = Summary(np.zeros((4, 0), np.int64), [], np.zeros(0, np.int64))

    def learn(self, chunks: list[str]) -> None:
        """Takes in new chunks."""
        made = self.summary([c.encode() for c in chunks], self.aligner.encode_chunks)
        old = len(self.number)
        self.number.update(zip(chunks, range(old, old + len(chunks)), strict=True))
        self.held.counts = np.concatenate([self.held.counts, made.counts], axis=1)
        self.held.groups.extend(made.groups)
        self.held.links = np.concatenate([self.held.links, made.links])

    def summary(self, raws: list[bytes], encode: Callable[[list[bytes]], tuple[Aligned, np.ndarray, np.ndarray]]) -> Summary:
        """Products of some chunks or whole texts, BATCH_BYTES at a time."""
        counts, groups, links = [np.zeros((4, 0), np.int64)], [], [np.zeros(0, np.int64)]
        first, size = 0, 0
        for i, raw in enumerate(raws):
            size += len(raw) + 1
            if size >= BATCH_BYTES or i == len(raws) - 1:
                c, g, x = self._product(raws[first : i + 1], encode)
                counts.append(c)
                groups += g
                links.append(x)
                first, size = i + 1, 0
        return Summary(np.concatenate(counts, axis=1), groups, np.concatenate(links))

    def _product(self, raws: list[bytes], encode: Callable) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        both, n_a, n_b = encode(raws)
        i, j = both.end_links()
        left, right = both.groups()
        marked, before = self._write(both, left, right)
        ends = np.cumsum(n_a)
        n_links = np.diff(np.searchsorted(i, ends), prepend=0)  # links come by rising left token
        to = np.where(ends > 0, left.indices[np.maximum(ends, 1) - 1] + 1, 0) if len(both.a) else np.zeros(len(raws), np.int64)
        since = np.concatenate([[0], to[:-1]])
        line = b"".join(self._marked[marked])
        place = np.concatenate([[0], np.cumsum(self._size[marked])])
        texts = [line[a : b - 1] if b > a else b"" for a, b in zip(place[before[since]].tolist(), place[before[to]].tolist(), strict=True)]
        n_a = np.where((n_a == 0) & (np.array([len(r) for r in raws]) > 0), -1, n_a)
        return np.stack([n_a, n_b, to - since, n_links]), texts, both.a[i] << 32 | both.b[j]

    def _write(self, both: Aligned, left: Csr, right: Csr) -> tuple[np.ndarray, np.ndarray]:
        """Every id with the mark that follows it in ``a1,a2|b1;a3|b2,b3``, as numbers of marked ids in group order, and how many come before each group."""
        ga, gb = left.indices, right.indices
        na, nb = np.bincount(ga, minlength=left.width), np.bincount(gb, minlength=right.width)
        out = np.empty(len(ga) + len(gb), np.int64)
        last_a = np.append(ga[1:] != ga[:-1], True) if len(ga) else np.zeros(0, bool)
        last_b = np.append(gb[1:] != gb[:-1], True) if len(gb) else np.zeros(0, bool)
        # an id's place: its own number among its side's ids, and the other side's ids of the groups before (and of its own)
        out[np.arange(len(ga)) + (np.cumsum(nb) - nb)[ga]] = both.a + self._a * last_a
        out[np.arange(len(gb)) + np.cumsum(na)[gb]] = 2 * self._a + both.b + self._b * last_b
        return out, np.concatenate([[0], np.cumsum(na + nb)])

    def of_texts(self, raws: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Per text the four counts and the digest; and all links."""
        parts = [self._cut(raw) for raw in raws]
        new = {c for some in parts if some is not None for c in some if c not in self.number}
        if len(self.number) + len(new) > KEPT_CHUNKS:
            self.clear()
            new = {c for some in parts if some is not None for c in some}
        if new:
            self.learn(list(new))
        whole = [raw for raw, some in zip(raws, parts, strict=True) if some is None]
        more = self.summary(whole, self.aligner.encode)
        number, known = self.number, len(self.number)
        own = iter(range(known, known + len(whole)))
        rows = [[next(own)] if some is None else [number[c] for c in some] for some in parts]
        counts = np.concatenate([self.held.counts, more.counts], axis=1)
        links = np.concatenate([self.held.links, more.links])
        groups = self.held.groups + more.groups
        flat = np.fromiter(chain.from_iterable(rows), np.int64)
        ends = np.cumsum([len(r) for r in rows])
        bad = np.concatenate([[0], np.cumsum(counts[0, flat] < 0)])
        good = np.diff(bad[np.concatenate([[0], ends])]) == 0
        flat = flat[np.repeat(good, np.diff(ends, prepend=0))]
        rows = [r if ok else [] for r, ok in zip(rows, good, strict=True)]
        ends = np.cumsum([len(r) for r in rows])
        sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(counts[:, flat], axis=1)], axis=1)
        per_text = np.diff(sums[:, np.concatenate([[0], ends])], axis=1)
        first = np.cumsum(counts[3]) - counts[3]
        size = counts[3, flat]
        at = np.arange(int(size.sum())) + np.repeat(first[flat] - np.cumsum(size) + size, size)
        shas = [hashlib.sha256(b";".join([groups[k] for k in r])).hexdigest() if r else "" for r in rows]
        return per_text, shas, links[at]

    @staticmethod
    def _cut(raw: bytes) -> list[str] | None:
        """The chunks of a text without the space that each begins with; None if it has to stay whole."""
        if not raw:
            return []
        text = raw.decode("utf-8", "replace")
        if _WHOLE.search(text) or len(text.encode()) != len(raw):
            return None
        return text.split(" ")


_CHUNKS: dict[int, Chunks] = {}


def _chunks(byte_bpe: str, pieces: bytes) -> Chunks:
    """One per worker and pair of vocabularies."""
    key = hash((byte_bpe, pieces))
    if key not in _CHUNKS:
        _CHUNKS.clear()
        _CHUNKS[key] = Chunks(Aligner(byte_bpe, pieces))
    return _CHUNKS[key]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of up to a few times BATCH_BYTES at a time."""
    ids, raws, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_py()
            if raws and size + len(raw) > 4 * BATCH_BYTES:
                yield ids, raws
                ids, raws, size = [], [], 0
            ids.append(doc)
            raws.append(raw)
            size += len(raw) + 1
    if raws:
        yield ids, raws


def _rows_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(text).alias("text"))


def _summaries(byte_bpe: str, pieces: bytes, spark: SparkSession, id_type: pa.DataType) -> Callable:
    shared = spark.sparkContext.broadcast((byte_bpe, pieces))  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(*shared.value)
        for docs, raws in _batches(batches):
            (n_a, n_b, n_groups, n_links), shas, links = chunks.of_texts(raws)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, id_type), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_links),
                 pa.array(shas, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(links))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
            )
        chunks.clear()  # the worker lives on and may do other work next
        release_memory()

    return run


def align(
    docs: DataFrame, byte_bpe: str, pieces: bytes, doc_id: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``byte_bpe`` is the content of a byte-level vocabulary file, which encodes a space and the text, ``pieces`` that of a piece
    model, which adds the space itself. Links join tokens whose bytes end together. A pair of ids counts as often as the corpus
    links it; ``n_best`` are the links whose count is the highest of their right id, ``count_sum`` adds the counts up. Texts that
    are null, empty or that either side can't give back byte by byte have zeros and an empty digest. Repeated rows and
    null ids keep their rows; an empty table gives an empty result; other columns are not looked at.
    """
    rows = _rows_of(docs, doc_id, text)
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(
        _summaries(byte_bpe, pieces, docs.sparkSession, to_arrow_type(rows.schema["doc_id"].dataType)),
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>",
    )
    found = cut_lineage(found.withColumn("uid", F.monotonically_increasing_id()))
    counts = pair_counts(found)
    own = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    linked = found.select(*own, F.explode("links").alias("link")).join(counts, "link")
    summed = linked.groupBy(*own).agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("times").alias("count_sum"))
    none = found.where(F.size("links") == 0).select(*own, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return summed.unionByName(none).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def pair_counts(found: DataFrame) -> DataFrame:
    """(link, times, best) per id pair linked anywhere: counts are summed before the shuffle, a right id has no more pairs than the left vocabulary has ids."""
    counts = found.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("times"))
    highest = F.max("times").over(Window.partitionBy(F.col("link").bitwiseAND(F.lit(_LOW))))
    return cut_lineage(counts.select("link", "times", (F.col("times") == highest).alias("best")))


def links(
    docs: DataFrame,
    byte_bpe: str,
    pieces: bytes,
    share: str = "bytes",
    doc_id: str = "doc_id",
    text: str = "text",
    pairs_at_once: int = PAIRS_AT_ONCE,
) -> DataFrame:
    """The products themselves, one row (doc_id, a_at, b_at, a_id, b_id, shared) per pair of tokens of a text.

    ``share="bytes"`` gives pairs that overlap and their shared bytes, ``share="group"`` pairs of one group. Products are taken
    by blocks of rows, so a group of many tokens needs no more memory than one row of it.
    """
    if share not in ("bytes", "group"):
        raise ValueError("tokens share bytes or a group")
    rows = _rows_of(docs, doc_id, text)
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    shared = docs.sparkSession.sparkContext.broadcast((byte_bpe, pieces))  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _chunks(*shared.value).aligner
        for docs, raws in _batches(batches):
            both, n_a, n_b = aligner.encode(raws)
            left, right = (Csr.spans(both.a_end), Csr.spans(both.b_end)) if share == "bytes" else both.groups()
            right = right.transposed()
            owner = np.repeat(np.arange(len(raws)), n_a)
            first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            cost = np.concatenate([[0], np.cumsum(np.diff(right.indptr)[left.indices])])[left.indptr]
            at = 0
            while at < left.height:
                to = max(at + 1, int(np.searchsorted(cost, cost[at] + pairs_at_once, side="right")) - 1)
                part = left.rows(at, to).times(right)
                i = np.repeat(np.arange(at, to), np.diff(part.indptr))
                j, doc = part.indices, owner[i]
                yield pa.record_batch({
                    "doc_id": pa.array(docs, id_type).take(pa.array(doc)), "a_at": pa.array(i - first_a[doc]), "b_at": pa.array(j - first_b[doc]),
                    "a_id": pa.array(both.a[i]), "b_id": pa.array(both.b[j]), "shared": pa.array(part.data),
                })
                at = to
            release_memory()

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, a_at long, b_at long, a_id long, b_id long, shared long")
