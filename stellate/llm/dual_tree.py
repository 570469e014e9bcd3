"""Ranked lexical search by dual trees: the best documents of every item, exactly.

An item is a set of terms, a document a sparse vector of term impacts, and a score the weighted sum over the item's terms. Items
form one tree and the documents of a batch another; a node holds, per term, the largest coordinate below it. The product of two
nodes' maxima bounds every score of a pair below them. Where the bound of a pair of nodes stays below the weakest k-th score of
the items under it, no pair below can enter a list, and the whole batch of pairs is left out; the rest is scored in full.

Lists start from the k-th scores over a hashed share of the documents, which bound the k-th scores over all from below, so that
what tasks return depends on the items and that share, not on the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.llm.common import plain_words, release_memory, utf8
from stellate.session import cut_lineage

#: Documents that a tree covers, documents of a leaf, children of a node.
TREE_DOCS, LEAF, FANOUT = 4096, 32, 8
#: Bytes of distinct item texts that are looked up together; more are looked up block by block.
BLOCK_BYTES = 8 << 20
#: One of so many documents takes part in the first search, which only sets where lists start.
FIRST_SHARE = 32
_EXACT = float(1 << 53)


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) per term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)


def impacts(tf: np.ndarray, row: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What the occurrences of a term in document ``row`` add per unit of weight, by the document's terms ``n`` against the mean."""
    length = np.array([50 + (50 * x * documents) // terms for x in n.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * length[row])


def _sums(rows: np.ndarray, values: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Exact integer sums per row; doubles hold them up to 2^53, beyond that halves are summed apart."""
    if float(values.sum(dtype=np.float64)) < _EXACT:
        return np.bincount(rows, values, n).astype(np.int64)
    high = np.bincount(rows, values >> 26, n).astype(np.int64)
    return (high << 26) + np.bincount(rows, values & ((1 << 26) - 1), n).astype(np.int64)


@dataclass
class Level:
    """Maxima of the nodes of one level of documents: per term (``first[t]`` to ``first[t + 1]``) the nodes and their values."""

    first: np.ndarray
    node: np.ndarray
    value: np.ndarray
    size: int

    @classmethod
    def of(cls, term: np.ndarray, node: np.ndarray, value: np.ndarray, terms: int, size: int) -> Level:
        order = np.lexsort((node, term))
        term, node, value = term[order], node[order], value[order]
        if len(term):
            start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (node[1:] != node[:-1])]))
            term, node, value = term[start], node[start], np.maximum.reduceat(value, start)
        return cls(np.searchsorted(term, np.arange(terms + 1)), node, value, size)

    def dot(self, terms: np.ndarray, weights: np.ndarray, open_nodes: np.ndarray) -> np.ndarray:
        """Per node the weighted sum of its values over ``terms``; 0 for nodes that aren't open."""
        size = self.first[terms + 1] - self.first[terms]
        total = int(size.sum())
        if not total:
            return np.zeros(self.size, np.int64)
        at = np.arange(total) - np.repeat(np.cumsum(size) - size - self.first[terms], size)
        node, value = self.node[at], self.value[at] * np.repeat(weights, size)
        keep = open_nodes[node]
        return _sums(node[keep], value[keep], self.size)


@dataclass
class Node:
    """Items below, the union of their terms, and children; a leaf is one item."""

    items: list[int]
    terms: np.ndarray
    children: list[Node]


def item_tree(terms_of: list[np.ndarray]) -> Node:
    """Items in the order of their terms (numbers rise with the share of items that hold them, so those that share a rare term are neighbours)."""
    order = sorted(range(len(terms_of)), key=lambda i: terms_of[i].tolist())
    level = [Node([i], terms_of[i], []) for i in order] or [Node([], np.zeros(0, np.int64), [])]
    while len(level) > 1:
        level = [
            Node([i for n in some for i in n.items], np.unique(np.concatenate([n.terms for n in some])), some)
            for some in (level[a : a + FANOUT] for a in range(0, len(level), FANOUT))
        ]
    return level[0]


class Best:
    """The best k documents per item seen so far, and the score that a further one must reach."""

    def __init__(self, items: int, k: int, least: np.ndarray) -> None:
        self.k = k
        self.least = np.maximum(least, 1)
        none = np.zeros(0, np.int64)
        self.score = [none] * items
        self.doc = [none] * items
        self.null = [none.astype(bool)] * items

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score = np.concatenate([self.score[item], score])
        doc = np.concatenate([self.doc[item], doc])
        null = np.concatenate([self.null[item], null])
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score[item], self.doc[item], self.null[item] = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], score[order[-1]])


class DocumentTree:
    """A batch of documents: their impacts, and the maxima of leaves, of groups of leaves, and so on up to one root."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, length: np.ndarray, terms: int) -> None:
        n = len(doc)
        # neighbours share their rarest term, then have a like length: term numbers rise with how common a term is
        rarest = np.full(n, terms)
        np.minimum.at(rarest, row, term)
        order = np.lexsort((length, rarest))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.doc, self.null = doc[order], null[order]
        row = place[row]
        self.levels = [Level.of(term, row, impact, terms, n)]
        self.widths = [LEAF]
        size, node = n, row
        while size > 1:
            node = node // self.widths[-1]
            size = -(-size // self.widths[-1])
            self.levels.append(Level.of(term, node, impact, terms, size))
            self.widths.append(FANOUT)

    def search(self, tree: Node, weights: np.ndarray, best: Best) -> tuple[int, int]:
        """Updates ``best``; returns how many pairs of an item and a document there are and how many were scored."""
        scored = 0

        def below(mask: np.ndarray, level: int) -> np.ndarray:
            return mask[np.arange(self.levels[level].size) // self.widths[level]]

        def visit(node: Node, level: int, mask: np.ndarray) -> None:
            """``mask``: nodes of ``level`` that may hold a document for an item below ``node``."""
            nonlocal scored
            least = best.least[node.items].min()
            bound = self.levels[level].dot(node.terms, weights[node.terms], mask)
            if level == 0 and not node.children:
                item = node.items[0]
                scored += int(mask.sum())
                hit = np.flatnonzero(bound >= least)
                if len(hit):
                    best.add(item, bound[hit], self.doc[hit], self.null[hit])
                return
            left = bound >= least
            if not left.any():
                return
            lower = below(left, level - 1) if level else left
            for child in node.children or [node]:
                visit(child, max(level - 1, 0), lower)

        top = len(self.levels) - 1
        visit(tree, top, np.ones(self.levels[top].size, bool))
        return len(tree.items) * len(self.doc), scored


def _postings(vocabulary, spark):
    shared = spark.sparkContext.broadcast(vocabulary)  # distinct terms of at most BLOCK_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            length, sizes, terms, tfs = [], [], [], []
            for text in batch.column("text"):
                words = plain_words(text.as_py())
                hits = np.fromiter((t for t in map(get, words) if t is not None), np.int64)
                term, tf = np.unique(hits, return_counts=True)
                length.append(len(words))
                sizes.append(len(term))
                terms.append(term)
                tfs.append(tf)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32)) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(length, pa.int64()), *[pa.ListArray.from_arrays(offsets, x) for x in flat]],
                ["doc_id", "n", "terms", "tfs"],
            )
        release_memory()

    return run


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of, place, weights, documents, total, least = shared.value
        tree = item_tree(terms_of)
        best = Best(len(terms_of), k, least.copy())
        held: list[pa.RecordBatch] = []
        rows = 0
        place = place.astype(np.int64)

        def flush() -> None:
            nonlocal held, rows
            if not rows:
                return
            part = pa.Table.from_batches(held).combine_chunks()
            ids = part["doc_id"].combine_chunks()
            n = part["n"].to_numpy()
            lists = part["terms"].combine_chunks()
            row = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
            term = place[lists.flatten().to_numpy()]
            tf = part["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            impact = impacts(tf, row, n, documents, total)
            docs = DocumentTree(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), row, term, impact, n, len(weights))
            docs.search(tree, weights, best)
            held, rows = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, TREE_DOCS):
                some = batch.slice(at, TREE_DOCS)
                if rows + some.num_rows > TREE_DOCS:
                    flush()
                held.append(some)
                rows += some.num_rows
        flush()
        for item in range(len(terms_of)):
            n = len(best.score[item])
            if n:
                yield pa.record_batch({
                    "item": pa.array([item] * n, pa.int32()), "doc_id": pa.array(best.doc[item], mask=best.null[item]),
                    "score": pa.array(best.score[item]),
                })
        release_memory()

    return run


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each item's ``k`` best rows of ``docs``: item_id, rank, doc_id, score. Ids of documents are integers.

    Terms are runs of letters, digits and characters above 0x7F, with A-Z lower-cased; null texts have none. Scores are above 0;
    equal ones rank by rising doc_id, null ids last, equal rows in any order. Every row of ``docs`` is a document and every row of
    ``items`` an item of its own, repeated or without id as it may be. Items without a term that any document holds have no rows; an empty table of
    either kind gives an empty result; other columns are not looked at. Distinct item texts are searched in blocks of bounded size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), utf8(text).alias("text"))
    queries = items.select(F.col(f"`{item_id}`").alias("item_id"), utf8(item_text).alias("text"))
    queries = cut_lineage(queries.select("item_id", "text", F.sha2("text", 256).alias("key")))
    texts = queries.select("key", "text").dropDuplicates(["key"])
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        some = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).orderBy("key")
        part = _search_block(rows, some.collect(), k)  # one block, about block_bytes
        found = part if found is None else found.unionByName(part)
    named = queries.select("item_id", "key").join(found, "key")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(rows: DataFrame, texts: list, k: int) -> DataFrame:
    """(key, rank, doc_id, score) for the items of one block."""
    spark = rows.sparkSession
    words = [sorted(set(plain_words(bytes(r["text"])))) for r in texts]
    held: dict[bytes, int] = {}
    for some in words:
        for word in some:
            held[word] = held.get(word, 0) + 1
    number = {w: i for i, w in enumerate(sorted(held, key=lambda w: (held[w], w)))}
    table = rows.mapInArrow(_postings(number, spark), "doc_id long, n long, terms array<int>, tfs array<int>")
    table = cut_lineage(table.where("n > 0"))
    corpus = table.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(number), np.int64)
    for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the block's terms
        df[r["term"]] = r["count"]
    # terms are numbered anew, rare ones first, as trees sort by them
    order = np.lexsort((np.arange(len(df)), df))
    place = np.empty(len(df), np.int64)
    place[order] = np.arange(len(df))
    weights = term_weights(df[order], corpus["documents"])
    terms_of = [np.sort(place[[number[w] for w in some]]) if some else np.zeros(0, np.int64) for some in words]
    hits = table.where(F.size("terms") > 0)
    total = corpus["terms"] or 1

    def run(some: DataFrame, least: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((terms_of, place, weights, corpus["documents"], total, least))  # one block's items
        return some.mapInArrow(_search(shared, k), "item int, doc_id long, score long")

    least = np.zeros(len(words), np.int64)
    if words:
        first = hits.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_SHARE)) == 0)
        kth = _best_of(run(first, least), k).where(F.col("rank") == k)
        for r in kth.select("item", "score").collect():  # at most one row per item of the block
            least[r["item"]] = r["score"]
    keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(texts)], "item int, key string")
    return cut_lineage(_best_of(run(hits, least), k)).join(keys, "item").select("key", "rank", "doc_id", "score")
