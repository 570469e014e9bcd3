"""SimHash near-duplicates: segment popcounts embed fingerprints, a grid joins them, XOR verifies.

A fingerprint's 64 bits are cut into 32 segments of two bits; the popcount of
each segment (0, 1 or 2) is one coordinate. The Manhattan distance of two such
points never exceeds the number of differing bits, so fingerprints within
``max_bits`` = 3 are within Manhattan distance 3. Their coordinates fall into two halves of 16,
and in one of them the distance is at most 1. The grid therefore has one cell
per half and point of that half: a fingerprint lies in its own two cells and
probes those one step up in one coordinate (the step down is the other side's
step up). What shares a cell is verified exactly by XOR and popcount.

Links are never listed in full. A cell returns a spanning forest of its links,
found by joining everything within reach of a pivot first, so a cell of n
near-copies costs a few times n and returns at most n - 1 links. Cells above a row
limit are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import release_memory, unique_prefix, utf8
from stellate.llm.components import components
from stellate.session import cut_lineage

#: Rows of a cell that one task compares; larger cells are dealt out as block pairs.
CELL_ROWS = 4096
#: Cells up to this size are compared all at once.
SMALL_CELL = 16
_BITS_AT_ONCE = 1 << 14


def fingerprint_of(text: bytes, shingle: int, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words.

    Words are runs without 0x20 and 0x09 to 0x0D, A-Z lower-cased. Repeated
    shingles count each time; a bit is set if it is set in over half of them.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(shingle)), strict=False)
    hashes = np.fromiter((digest(b" ".join(g), seed) for g in grams), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        block = hashes[at : at + _BITS_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed long; null counts as empty."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        release_memory()
        return pa.array(values.view(np.int64))

    return run(utf8(text))


def segment_counts(half: Column) -> Column:
    """The popcounts of the 16 two-bit segments of a 32-bit half, each in place of its segment."""
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))


def _cells(prints: DataFrame) -> DataFrame:
    """Grid rows (cell, fp, probe): two own cells and one per possible step up in a coordinate.

    The cell is the half's 16 coordinates in 32 bits, with bit 32 set for the upper half.
    """
    low = segment_counts(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    high = segment_counts(F.shiftrightunsigned("fp", 32))
    halves = prints.select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("own"))
    field = [F.shiftright("own", 2 * i).bitwiseAND(F.lit(3)) for i in range(16)]
    up = F.array(*[F.when(c < 2, F.col("own") + F.lit(1 << 2 * i)) for i, c in enumerate(field)])
    both = F.array_compact(F.concat(F.array("own"), up))
    return halves.select("fp", F.posexplode(both).alias("_at", "cell")).select(
        "cell", "fp", (F.col("_at") > 0).alias("probe")
    )


def _bits(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint64))  # of a signed value it would count the magnitude's


def forest(own: np.ndarray, probe: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what the links own-own and own-probe within ``max_bits`` join, at most n - 1 of them.

    A pivot takes in everything within reach at once. Later rows are compared
    only with rows that are not in their group yet.
    """
    values = np.concatenate([own, probe])
    n, n_own = len(values), len(own)
    group = np.arange(n)
    out: list[tuple[int, int]] = []
    open_rows = np.ones(n, bool)  # rows whose links may not all be known
    while open_rows[:n_own].any():
        # the next pivot is an open row of the smallest group, so the largest is hardly ever walked
        rows = np.flatnonzero(open_rows[:n_own])
        sizes = np.bincount(group, minlength=n)
        pivot = rows[np.argmin(sizes[group[rows]])]
        mine = group[pivot]
        others = group != mine
        if not others.any():
            break
        near = np.flatnonzero(others & (_bits(values ^ values[pivot]) <= max_bits))
        for g in np.unique(group[near]):
            member = near[group[near] == g][0]
            out.append((pivot, member))
            group[group == g] = mine
        open_rows[pivot] = False
    return [(int(values[a]), int(values[b])) for a, b in out if values[a] != values[b]]


def _small_cells(fp: np.ndarray, probe: np.ndarray, run_of: np.ndarray, width: int, max_bits: int) -> np.ndarray:
    """All links in cells of at most ``width`` rows, comparing each row with those 1, 2, ... places on."""
    found = []
    for step in range(1, width):
        a, b = slice(None, -step), slice(step, None)
        close = (run_of[a] == run_of[b]) & ~(probe[a] & probe[b]) & (_bits(fp[a] ^ fp[b]) <= max_bits)
        at = np.flatnonzero(close & (fp[a] != fp[b]))
        found.append(np.stack([np.minimum(fp[at], fp[at + step]), np.maximum(fp[at], fp[at + step])], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _linked(max_bits: int):
    """Links of whole cells, from a partition sorted by cell; a cell is at most a few times the row limit."""

    def links_of(frame: pa.Table) -> pa.RecordBatch:
        cell, block = frame["cell"].to_numpy(), frame["block"].to_numpy()
        fp, probe = frame["fp"].to_numpy(), frame["probe"].to_numpy()
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(cell)))
        run_of = np.cumsum(new) - 1
        little = (size <= SMALL_CELL)[run_of]
        links = [_small_cells(fp[little], probe[little], run_of[little], SMALL_CELL, max_bits)]
        for i in np.flatnonzero(size > SMALL_CELL):
            rows = slice(start[i], start[i] + size[i])
            own = np.unique(fp[rows][~probe[rows]])
            if len(own):
                links.append(np.array(forest(own, np.unique(fp[rows][probe[rows]]), max_bits), np.int64).reshape(-1, 2))
        both = np.concatenate(links)
        return pa.record_batch({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            frame = (pa.concat_tables([kept, part]) if kept is not None else part).combine_chunks()
            cell, block = frame["cell"].to_numpy(), frame["block"].to_numpy()
            earlier = np.flatnonzero((cell != cell[-1]) | (block != block[-1]))
            cut = int(earlier[-1]) + 1 if len(earlier) else 0
            if cut:
                yield links_of(frame.slice(0, cut))
            kept = frame.slice(cut)
        if kept is not None and len(kept):
            yield links_of(kept)

    return run


def links_between(prints: DataFrame, max_bits: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) among distinct fingerprints that join exactly what all links within ``max_bits`` join."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves and one step cover up to three differing bits")
    grid = _cells(prints)
    sizes = cut_lineage(grid.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > cell_rows))
    if sizes.limit(1).isEmpty():
        dealt = grid.withColumn("block", F.lit(0).cast("long"))
    else:
        blocks = F.ceil(2 * F.coalesce(F.col("_rows"), F.lit(1)) / cell_rows).cast("long")
        mine = F.pmod(F.xxhash64("fp"), blocks)
        every = F.sequence(F.lit(0).cast("long"), blocks - 1)
        dealt = (
            grid.join(sizes, "cell", "left")
            .withColumn("block", F.explode(F.when(F.col("_rows").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
                F.transform(every, lambda j: F.greatest(mine, j) * blocks + F.least(mine, j)))))
            .select("cell", "fp", "probe", "block")
        )
    placed = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block")
    return placed.mapInArrow(_linked(max_bits), "a long, b long")


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id, root) per distinct fingerprint of ``prints`` (doc_id, fp): its group's smallest id, and what the group shares."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(cut_lineage(links_between(distinct.select("fp"), max_bits)))
    rooted = cut_lineage(
        distinct.join(cut_lineage(roots), F.col("fp") == F.col("node"), "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        )
    )
    least = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return cut_lineage(rooted.join(least, "root").select("fp", "component_id", "root"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other. The component id is the
    smallest id reachable over links of at most ``max_bits`` differing bits; a null id
    keeps its row, and a component of null ids only has a null id. Repeated rows stay. An empty
    table gives an empty result; other columns are not looked at.
    """
    prints = cut_lineage(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint(text, shingle).alias("fp")))
    named = _classes(prints, max_bits).select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """One row of ``docs``, with all its columns, of each group of near-duplicates.

    The row with the group's smallest id stays, and of several texts under that id (rows may repeat an id) the
    one with the smallest hash; of rows that repeat both any one. Rows without an id come after all ids; a group without any
    keeps one row as well. Every row belongs to one group, so no group is lost. An empty table gives an empty result.
    """
    mark = unique_prefix(docs, "_key")
    content = F.xxhash64(utf8(text))
    prints = cut_lineage(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint(text, shingle).alias("fp"), content.alias("hash")))
    classes = _classes(prints.select("doc_id", "fp"), max_bits).select("fp", "root")
    # a row per group and task is shuffled, however large the group
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    first = prints.join(classes, "fp").groupBy("root").agg(F.min(order).alias("f")).select("f.*")

    def key(id_: Column, hash_: Column) -> Column:
        return F.concat(F.when(id_.isNull(), "none").otherwise(F.concat(F.lit("id "), F.coalesce(id_.cast("string"), F.lit("")))), F.lit(" "), hash_.cast("string"))

    stays = unique_prefix(docs, "_stays")
    kept = cut_lineage(first.select(key(F.col("doc_id"), F.col("hash")).alias(stays)))
    # rows meet what stays by one shuffle of the documents, at every size, and copies of a row are reduced where they lie
    rows = docs.withColumn(mark, key(F.col(f"`{doc_id}`"), content)).join(kept.hint("merge"), F.col(mark) == F.col(stays), "left_semi")
    return rows.dropDuplicates([mark]).drop(mark)
