"""Personal data by bootstrapped contextual extraction.

Identifiers of a fixed form (e-mail, IP, card and phone numbers) are the seeds. The words around them are lexical
patterns, the same patterns also stand around strings that look like identifiers but have no fixed form. Patterns and instances make
up a graph: a pattern is worth what share of its distinct instances is believed in, an instance is believed in as far as its
patterns are worth something, and both are scored in rounds over the whole corpus. Instances that good patterns point to
are identifiers of the kind that these patterns otherwise surround, wherever they stand.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stellate.llm.common import release_memory, utf8
from stellate.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds that a pattern needs, its least worth, the least belief in an instance, and rounds at most.
SUPPORT, WORTH, BELIEF, ROUNDS = 3, 0.6, 0.75, 4
#: Digits that a string without @ needs to look like an identifier.
DIGITS = 7
#: Bytes on either side, in the same line, where context words are looked for.
REACH = 80

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(rb"[0-9@]")
_RUN = re.compile(rb"[0-9A-Za-z@._%+/()-]*")
_IN_RUN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+/()-")
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_DIGIT = re.compile(rb"[0-9]")
_NAMED = re.compile(rb"[A-Za-z@]")
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_FIELD = b":=#"


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches in a row: what stands before an @ reaches back to the last other character, or to the match before."""
    at, end = raw.find(b"@"), 0
    while at >= 0:
        start = at
        while start > end and raw[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(raw, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
            at = raw.find(b"@", end)
        else:
            at = raw.find(b"@", at + 1)


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start and then kind; linear in the text."""
    found = [(s, 0, e) for s, e in emails(raw)]
    for m in _IP.finditer(raw):
        if all(len(p := x.lstrip(b"0")) < 4 and int(p or b"0") <= 255 for x in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(raw):
        if m.end() - m.start() >= 12:
            digits = m.group().translate(None, _NOT_DIGIT)
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if b"+" in raw:
        for m in _PHONE.finditer(raw):
            if 9 <= len(m.group().translate(None, _NOT_DIGIT)) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def candidates(raw: bytes, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Strings outside the base spans that hold an @ or DIGITS digits: runs of identifier characters, and numbers in groups."""
    taken = sorted((s, e) for _, s, e in base)
    out, end, t = [], 0, 0
    sign = _SIGN.search(raw)
    while sign:
        at = sign.start()
        while t < len(taken) and taken[t][1] <= at:
            end = max(end, taken[t][1])
            t += 1
        if t < len(taken) and taken[t][0] <= at:
            end = taken[t][1]
            sign = _SIGN.search(raw, end)
            continue
        stop = taken[t][0] if t < len(taken) else len(raw)
        start = at
        while start > end and raw[start - 1] in _IN_RUN:
            start -= 1
        end = _RUN.match(raw, at, stop).end()
        while end + 1 < stop and raw[end] == 32 and raw[end - 1] in b"0123456789)" and raw[end + 1] in b"0123456789(":
            end = _RUN.match(raw, end + 1, stop).end()
        body = raw[start:end]
        kept = body.lstrip(b"._%/)-@")
        first = start + len(body) - len(kept)
        kept = kept.rstrip(b"._%+/(-@" if b"(" in kept else b"._%+/(-@)")
        if b"@" in kept or len(kept.translate(None, _NOT_DIGIT)) >= DIGITS:
            out.append((first, first + len(kept)))
        sign = _SIGN.search(raw, max(end, at + 1))
    return out


def _plain(word: bytes) -> bytes:
    return _DIGIT.sub(b"0", word.lower())


def patterns(raw: bytes, start: int, end: int) -> list[str]:
    """Lexical patterns of the string at ``start`` to ``end``: two words before it; a word on either side; a field's name."""
    before = raw[max(0, start - REACH) : start]
    line = before.rfind(b"\n") + 1
    if not line and start > REACH:
        line = before.find(b" ") + 1  # a word that the reach cuts isn't looked at
    words = list(_WORD.finditer(before, line))[-2:]
    if not words:
        return []
    left = [_plain(w.group()) for w in words]
    after = raw[end : end + REACH]
    right = _WORD.search(after, 0, after.find(b"\n") if b"\n" in after else len(after))
    field = next((bytes([c]) for c in before[words[-1].end() :] if c in _FIELD), b"")
    out = []
    if len(left) > 1:
        out.append(left[-2] + b" " + left[-1] + field + b" _")
    if right:
        out.append(left[-1] + field + b" _ " + _plain(right.group()))
    if field:
        out.append(left[-1] + field + b" _")
    return [x.decode("utf-8", "replace") for x in out]


def instance_of(kept: bytes) -> int:
    """What makes two strings the same identifier: their digits, or if they have letters or are like an IP, the string in lower case."""
    same = kept.lower() if _NAMED.search(kept) or _IP.fullmatch(kept) else kept.translate(None, _NOT_DIGIT)
    return xxhash.xxh64_intdigest(same) - (1 << 63)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _points(raw: bytes, spans: list) -> list:
    """Spans in code points instead of bytes; the last two members of each are its ends, in rising order of start."""
    if raw.isascii() or not spans:
        return spans
    places = sorted({p for s in spans for p in s[-2:]})
    at, count, point = 0, 0, {}
    for p in places:
        count += len(raw[at:p].decode("utf-8", "replace"))
        point[p], at = count, p
    return [(*s[:-2], point[s[-2]], point[s[-1]]) for s in spans]


_FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:string,start:long,end:long>>, "
    "others array<struct<instance:long,start:long,end:long>>, edges array<struct<pattern:string,instance:long,kind:string>>"
)


def _found(id_type: pa.DataType):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    other = pa.struct([("instance", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    edge = pa.struct([("pattern", pa.string()), ("instance", pa.int64()), ("kind", pa.string())])
    kinds = [id_type, *[pa.int64()] * 4, pa.string(), pa.list_(span), pa.list_(other), pa.list_(edge)]
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "others", "edges"]

    def of(raw: bytes) -> tuple:
        base = base_spans(raw) if _SIGN.search(raw) else []
        others = [(instance_of(raw[s:e]), s, e) for s, e in candidates(raw, base)] if _SIGN.search(raw) else []
        edges = [(p, i, k) for k, s, e in base for i in (instance_of(raw[s:e]),) for p in patterns(raw, s, e)]
        edges += [(p, i, None) for i, s, e in others for p in patterns(raw, s, e)]
        base, others = _points(raw, base), _points(raw, others)
        digest = hashlib.sha256(_joined(base).encode()).hexdigest()
        return (*[sum(x[0] == k for x in base) for k in KINDS], digest, base, others, edges)

    def listed(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
        return pa.array([[dict(zip(kind.value_type.names, x, strict=True)) for x in r] for r in rows], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = list(zip(*[of(t.as_py()) for t in batch.column("text")], strict=True))
            plain = [pa.array(c, k) for c, k in zip(columns[:5], kinds[1:6], strict=True)]
            lists = [listed(c, k) for c, k in zip(columns[5:], kinds[6:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *plain, *lists], names)
        release_memory()

    return run


def _spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    support: int = SUPPORT, worth: float = WORTH, belief: float = BELIEF, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are those of the fixed forms alone; ``spans`` also has what the patterns discover, as kind:start:end in
    code points, by start and kind. Null and empty texts have no spans. Null ids and repeated rows keep their row (copies of a
    context or an identifier count once in the graph); an empty table gives an empty result; other columns are not looked at.
    """
    return bootstrap(docs, doc_id, text, support, worth, belief, rounds)[0]


def bootstrap(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    support: int = SUPPORT, worth: float = WORTH, belief: float = BELIEF, rounds: int = ROUNDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``identify``, the patterns found good (pattern, kind, seeds, instances, worth), and the instances
    discovered (instance, kind, belief), which are named by hash."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(text).alias("text"))
    found = rows.mapInArrow(_found(to_arrow_type(rows.schema["doc_id"].dataType)), f"doc_id {dict(rows.dtypes)['doc_id']}, {_FOUND}")
    found = cut_lineage(found.withColumn("uid", F.monotonically_increasing_id()))
    edges = found.select(F.explode("edges").alias("e")).select("e.*").distinct()
    edges = cut_lineage(edges)
    seeds = cut_lineage(edges.where("kind is not null").select("instance", "kind").distinct())
    pairs = cut_lineage(edges.select("pattern", "instance").distinct())
    sizes = cut_lineage(pairs.groupBy("pattern").agg(F.count("*").alias("instances")))
    sure = seeds.select("instance", "kind", F.lit(1.0).alias("belief"), F.lit(True).alias("seed"))
    new = sure.where("false")
    good = None
    for _ in range(rounds):
        good = _score_patterns(pairs, sizes, sure.unionByName(new), support, worth)
        before = new
        new = cut_lineage(_score_instances(pairs, good, seeds, belief))
        if before.count() == new.count():  # belief only grows, so equal numbers are equal instances
            break
    # a known identifier written in another way is one as well
    known = seeds.groupBy("instance").agg(F.min("kind").alias("kind")).unionByName(new.select("instance", "kind"))
    spots = found.select("uid", F.explode("others").alias("o")).select("uid", "o.*")
    more = spots.join(known, "instance").groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    order = F.array(*[F.lit(k) for k in KINDS])
    both = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:long,end:long>>")))
    keyed = F.transform(both, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = found.join(more, "uid", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _spans_text(F.sort_array(keyed)).alias("spans")
    )
    return out, good, new.drop("seed")


def _score_patterns(pairs: DataFrame, sizes: DataFrame, believed: DataFrame, support: int, worth: float) -> DataFrame:
    """A pattern's worth for a kind: belief in its distinct instances, over one more than their number."""
    mass = pairs.join(believed, "instance").groupBy("pattern", "kind").agg(
        F.sum("belief").alias("mass"), F.sum(F.col("seed").cast("long")).alias("seeds")
    )
    scored = mass.join(sizes, "pattern").withColumn("worth", F.col("mass") / (F.col("instances") + 1))
    return cut_lineage(scored.where((F.col("seeds") >= support) & (F.col("worth") >= worth)).select("pattern", "kind", "seeds", "instances", "worth"))


def _score_instances(pairs: DataFrame, good: DataFrame, seeds: DataFrame, belief: float) -> DataFrame:
    """Belief that an instance is of a kind: that not all of its good patterns err; its best kind, seeds left out."""
    fresh = pairs.join(seeds, "instance", "left_anti").join(good, "pattern")
    scored = fresh.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("worth"))))).alias("belief"))
    best = scored.where(F.col("belief") >= belief).groupBy("instance").agg(F.max(F.struct("belief", "kind")).alias("b"))
    return best.select("instance", "b.kind", "b.belief", F.lit(False).alias("seed"))
