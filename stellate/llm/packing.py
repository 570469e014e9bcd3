"""Packing token sequences of one length by cutting-stock column generation.

A document's whole multiples of the sequence length are sequences of their own; what remains is a rest shorter
than a sequence. The histogram of rests (at most ``length`` counts) goes to a linear program over patterns of
length classes; the patterns, rounded down, are filled with documents ranked by length in their class. Documents
left over by rounding, and a share held back for it, form one stream that is cut to fill the ends of the pattern
sequences exactly; what the stream has left becomes full sequences and last ones whose sizes are powers of two.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.llm.common import release_memory
from stellate.llm.cutting_stock import solve
from stellate.llm.tokens import encoder
from stellate.session import cut_lineage

LENGTH, CLASS_WIDTH = 4096, 64
#: Tokens of a stream block: intervals meet only inside a block.
_BLOCK = 1 << 20
#: Rows per window group when running totals are taken.
_GROUP_BITS = 12

#: Bytes of text that are encoded at once.
_BYTES_AT_ONCE = 4 << 20


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in turn, about _BYTES_AT_ONCE of text at a time."""
    group = np.cumsum(pc.binary_length(batch.column("text")).to_numpy()) // _BYTES_AT_ONCE
    cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def tokenized(docs: DataFrame, doc_id: str, text: str, definition: str, end_id: int, length: int) -> DataFrame:
    """Per row: doc_id, ids (two bytes each, end id included), their number, and checksums of the full pieces and the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = np.array([end_id], "<u2").tobytes()

    def pieces(ids: np.ndarray, ends: np.ndarray) -> tuple[list[list[int]], list[int]]:
        """Checksums of each text's full pieces and of its rest."""
        wide = ids.astype("<u4").data.cast("B")
        full, rest, first = [], [], 0
        for end in ends.tolist():
            cut = first + (end - first) // length * length
            full.append([zlib.crc32(wide[4 * c : 4 * (c + length)]) for c in range(first, cut, length)])
            rest.append(zlib.crc32(wide[4 * cut : 4 * end]))
            first = end
        return full, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(shared.value)
        for batch in batches:
            for part in _by_bytes(batch):
                ids, counts = words.encode_all(part.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u2")
                ends = np.cumsum(counts + 1)
                full, rest = pieces(ids, ends)
                offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                columns = [part.column("doc_id"), raw, pa.array(counts + 1), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "tokens", "full_crc", "rest_crc"])
        words.forget()  # the worker lives on and may do other work next
        release_memory()

    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, tokens long, full_crc array<long>, rest_crc long")


def running_total(rows: DataFrame, order: str, value: str, out: str, bits: int = _GROUP_BITS) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one by the unique long ``order``.

    Rows are summed in groups of consecutive order values; only the groups' sums are totalled in one window.
    """
    rows = rows.withColumn("_group", F.shiftright(order, bits))
    sums = rows.groupBy("_group").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut_lineage(sums.select("_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(sums, "_group")
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_group", "_before")
    )


class Plan:
    """Pattern counts per class, and where a document of a given class and rank goes. All of it is small."""

    def __init__(self, counts: dict[int, int], length: int, width: int) -> None:
        """``counts``: number of rests by exact length, 1 to length - 1."""
        classes = math.ceil(length / width)
        demand = np.zeros(classes, np.int64)
        tokens = 0
        for rest, n in counts.items():
            demand[(rest - 1) // width] += n
            tokens += rest * n
        patterns = solve(demand, length // width)
        bins = sum(times for _, times in patterns)
        empty = max(0.0, bins * length - tokens)
        share = tokens / (tokens + empty) if tokens else 0.0  # the rest is held back to fill the ends
        self.slots: list[tuple[int, int, int, int, int]] = []  # class, first rank, per copy, first sequence, first place
        self.sequences = 0
        filled = np.zeros(classes, np.int64)
        for pattern, times in sorted(patterns, key=lambda p: p[0].tolist()):
            copies = int(times * share)
            # rounding may ask for no more documents than there are
            for u in np.flatnonzero(pattern):
                copies = min(copies, int((demand[u] - filled[u]) // pattern[u]))
            if copies <= 0:
                continue
            place = 0
            for u in np.flatnonzero(pattern)[::-1]:
                self.slots.append((int(u), int(filled[u]), int(pattern[u]), self.sequences, place))
                filled[u] += copies * pattern[u]
                place += int(pattern[u])
            self.sequences += copies
        self.filled = filled

    def rows(self, spark: SparkSession) -> DataFrame:
        """One row per class and pattern: at most classes x patterns of them."""
        last: dict[int, int] = {}
        out = []
        for u, first, per, sequence, place in reversed(self.slots):
            out.append((u, first, last.get(u, int(self.filled[u])), per, sequence, place))
            last[u] = first
        schema = "s_class int, s_first long, s_last long, s_per long, s_sequence long, s_place long"
        return spark.createDataFrame(out, schema)


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(
    docs: DataFrame,
    definition: str,
    end_id: int = 2,
    length: int = LENGTH,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = CLASS_WIDTH,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``definition`` is the vocabulary file's content. Null and empty texts are the end id alone; every row of ``docs``
    is a document of its own, so repeated rows and null ids are packed like any other. An empty table gives an empty
    result; other columns are not looked at. Sequences lie gapless from offset 0.
    """
    spark = docs.sparkSession
    if length % width:
        raise ValueError("the class width must divide the sequence length")
    tokens = tokenized(docs, doc_id, text, definition, end_id, length)
    table = cut_lineage(tokens.withColumn("uid", F.monotonically_increasing_id()))
    facts = table.drop("ids").withColumn("rest", F.col("tokens") % length)
    counts = {int(r["rest"]): r["count"] for r in facts.where("rest > 0").groupBy("rest").count().collect()}  # at most `length` rows
    plan = Plan(counts, length, width)

    # whole multiples of the length
    long = running_total(facts.where(F.col("tokens") >= length).withColumn("n", F.floor(F.col("tokens") / length)), "uid", "n", "at")
    whole = long.select("doc_id", "tokens", "at", F.posexplode("full_crc").alias("i", "crc")).select(
        "doc_id",
        (F.col("i") * length).cast("long").alias("start"),
        F.lit(length).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        (2 * (F.col("at") + F.col("i")) + 1).alias("sequence_id"),  # odd ids; even ones are patterns and the stream
        F.lit(0).cast("long").alias("offset"),
    )

    # rank rests within their class: hashed parts are numbered alone, and the parts' sizes give their first rank
    rests = facts.where("rest > 0").select(
        "uid", "doc_id", "tokens", "rest", "rest_crc",
        F.floor((F.col("rest") - 1) / width).cast("int").alias("class"),
        F.shiftright("uid", _GROUP_BITS).alias("part"),
    )
    sizes = rests.groupBy("class", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut_lineage(sizes.select("class", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    inside = Window.partitionBy("class", "part").orderBy(F.desc("rest"), "uid")
    ranked = cut_lineage(
        rests.join(firsts, ["class", "part"])
        .withColumn("rank", F.col("_first") + F.row_number().over(inside) - 1)
        .drop("part", "_first")
    )

    slot = F.broadcast(plan.rows(spark))  # at most classes x patterns rows
    fits = (F.col("class") == F.col("s_class")) & (F.col("rank") >= F.col("s_first")) & (F.col("rank") < F.col("s_last"))
    placed = ranked.join(slot, fits, "left")
    nth = F.col("rank") - F.col("s_first")
    seated = placed.where(F.col("s_class").isNotNull()).select(
        "uid", "doc_id", "tokens", "rest", "rest_crc",
        (F.col("s_sequence") + F.floor(nth / F.col("s_per"))).alias("sequence"),
        (F.col("s_place") + nth % F.col("s_per")).alias("place"),
    )
    in_sequence = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seats = cut_lineage(seated.withColumn("offset", F.coalesce(F.sum("rest").over(in_sequence), F.lit(0))))
    pieces = seats.select(
        "doc_id",
        (F.col("tokens") - F.col("rest")).alias("start"),
        F.col("rest").alias("length"),
        F.col("rest_crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        (2 * F.col("sequence")).alias("sequence_id"),
        "offset",
    )

    # the stream: documents without a seat, cut to fill the ends of the pattern sequences, then sequences of their own
    ends = seats.groupBy("sequence").agg((F.lit(length) - F.sum("rest")).alias("room")).where("room > 0")
    stream = ranked.join(slot, fits, "left_anti").select("uid", "rest", "tokens")
    flow = stream.agg(F.sum("rest").alias("n")).first()["n"] or 0
    room = ends.agg(F.sum("room").alias("n")).first()["n"] or 0
    more = max(0, flow - room)
    own = spark.range(more // length).select((F.col("id") + plan.sequences).alias("sequence"), F.lit(length).cast("long").alias("room"))
    tail = [(plan.sequences + more // length + i, n) for i, n in enumerate(_powers(more % length))]
    rooms = ends.unionByName(own).unionByName(spark.createDataFrame(tail, "sequence long, room long"))
    rooms = running_total(rooms, "sequence", "room", "begin").select(
        "sequence", "begin", (F.col("begin") + F.col("room")).alias("end"), (F.when(F.col("sequence") < plan.sequences, F.lit(length) - F.col("room")).otherwise(0)).alias("base")
    )
    flowing = running_total(stream, "uid", "rest", "begin").withColumn("end", F.col("begin") + F.col("rest"))
    cuts = _overlaps(flowing, rooms, flow)
    spread = cuts.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence", "offset"))).alias("cuts"))
    filled = table.select("uid", "doc_id", "ids", "tokens").join(spread, "uid").select(
        "doc_id", "tokens", F.arrays_zip("cuts", _checksums("ids", "cuts").alias("crc")).alias("both")
    )
    filled = filled.select("doc_id", "tokens", F.explode("both").alias("b")).select(
        "doc_id",
        F.col("b.cuts.start").alias("start"),
        F.col("b.cuts.length").alias("length"),
        F.col("b.crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        (2 * F.col("b.cuts.sequence")).alias("sequence_id"),
        F.col("b.cuts.offset").alias("offset"),
    )
    return whole.unionByName(pieces).unionByName(filled)


def _checksums(ids: str, cuts: str) -> Column:
    @F.arrow_udf("array<long>")
    def run(raw: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for data, some in zip(raw.to_pylist(), parts.to_pylist(), strict=True):
            wide = np.frombuffer(data, "<u2").astype("<u4").tobytes()
            out.append([zlib.crc32(wide[4 * c["start"] : 4 * (c["start"] + c["length"])]) for c in some])
        return pa.array(out, pa.list_(pa.int64()))

    return run(F.col(ids), F.col(cuts))


def _overlaps(stream: DataFrame, rooms: DataFrame, total: int) -> DataFrame:
    """Pieces (uid, start in the document, length, sequence, offset) where the tilings of 0 to ``total`` overlap.

    Both are cut at block borders; inside a block the borders of both, in order, are the pieces' borders, and
    each piece takes the document and the room that began last.
    """

    def by_block(rows: DataFrame, keep: list[Column]) -> DataFrame:
        blocks = F.sequence(F.floor(F.col("begin") / _BLOCK), F.floor((F.col("end") - 1) / _BLOCK))
        rows = rows.select("begin", "end", *keep, F.explode(blocks).alias("block"))
        return rows.select("block", F.greatest("begin", F.col("block") * _BLOCK).alias("at"), "begin", *[c for c in rows.columns if c not in ("block", "begin", "end")])

    docs = by_block(stream, [F.col("uid"), (F.col("tokens") - F.col("rest")).alias("skip")]).select(
        "block", "at", F.struct("uid", (F.col("skip") + F.col("at") - F.col("begin")).alias("start"), "at").alias("doc"),
        F.lit(None).cast("struct<sequence:long,offset:long,at:long>").alias("room"),
    )
    free = by_block(rooms, [F.col("sequence"), F.col("base")]).select(
        "block", "at", F.lit(None).cast("struct<uid:long,start:long,at:long>").alias("doc"),
        F.struct("sequence", (F.col("base") + F.col("at") - F.col("begin")).cast("long").alias("offset"), "at").alias("room"),
    )
    here = docs.unionByName(free).groupBy("block", "at").agg(F.max("doc").alias("doc"), F.max("room").alias("room"))
    upto = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    following = Window.partitionBy("block").orderBy("at")
    pieces = here.select(
        "block", "at",
        F.last("doc", ignorenulls=True).over(upto).alias("doc"),
        F.last("room", ignorenulls=True).over(upto).alias("room"),
        F.coalesce(F.lead("at").over(following), (F.col("block") + 1) * _BLOCK).alias("next"),
    )
    length = F.least("next", F.lit(total)) - F.col("at")
    return pieces.where(length > 0).select(
        F.col("doc.uid").alias("uid"),
        (F.col("doc.start") + F.col("at") - F.col("doc.at")).alias("start"),
        length.alias("length"),
        F.col("room.sequence").alias("sequence"),
        (F.col("room.offset") + F.col("at") - F.col("room.at")).alias("offset"),
    )
