"""Main text of web pages: page structure first, a host's sorted suffixes for what structure leaves open.

Tags and class names decide most blocks: inside an article or main element, or in a menu, header, footer, sidebar, notice, advert,
form or comment. The suffixes of all pages of a host are also sorted to a depth of RUN tokens, as codes; suffixes that agree so far
and lie in several pages are repeated runs. On pages without an article or main element they
are cut out of the blocks, and unique runs stay.

Pages are packed into parts in the order they are read, whatever their host. A part lists each of its runs once, with the number
of its pages that have it; hash buckets sum the lists of all parts and answer each with the runs that are repeated. So
a host may have any number of pages. Few runs get that far: a repeated run's least code of SKETCH tokens repeats as
well, and these codes, a fifth as many and short, are summed first.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stellate.llm.common import release_memory
from stellate.llm.lm_score import packed, unpacked

#: Tokens of a repeated run, and pages it has to lie in.
RUN, PAGES = 12, 3
#: Pages and tokens that fill a part, and expected runs of a bucket.
PART_PAGES, PART_TOKENS, BUCKET_RUNS = 1 << 14, 1 << 20, 1 << 20
#: Tokens of the codes that are summed first, and their bits beyond those that number all tokens.
SKETCH, SPARE_BITS = 4, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)

CHROME, MAIN, OPEN = 0, 1, 2

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "noframes", "annotation", "annotation-xml"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    # formulas, drawings and what stands in for objects are text of their block
    "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mstyle", "semantics",
    "svg", "g", "text", "tspan", "path", "object", "param",
}
_DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset"}
_FORMS = {"form", "fieldset"}  # a page's article may lie in one
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu"}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion"}
_HINTS = _COMMENTS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "sidebar", "widget",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "share", "sharing",
    "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "skip", "login", "signup",
}
#: First parts of class names that make the last part no hint: ``with-header`` says what the element goes with, ``post-header`` is an article's own.
_BESIDE = {"with", "without", "has", "no", "is", "show", "hide", "js"}
_OWN = {"post", "entry", "article", "story", "content"}
#: Elements whose start ends an open one of the same kind.
_ENDS_SAME = {"p", "li", "option", "tr", "td", "th", "dt", "dd"}


def _hint(name: str) -> str | None:
    """The hint that a class or id gives by its first part or its last one, as in ``ad-box`` and ``site-header``."""
    parts = [p for p in re.split("[_-]+", name) if p]
    if not parts or parts[0] in _BESIDE:
        return None
    if parts[0] in _HINTS:
        return parts[0]
    return parts[-1] if parts[-1] in _HINTS and not (parts[0] in _OWN and parts[-1] == "header") else None


def _hints(attributes: str) -> tuple[set[str], str]:
    """Hints of the classes and the id, and the role."""
    words: set[str] = set()
    role = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            role = value.strip()
        else:
            words.update(h for h in map(_hint, value.split()) if h)
    return words, role


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order, white space as one space; neighbours of one decided zone are one block."""
    found: list[tuple[int, list[str]]] = []  # zone, pieces
    stack: list[tuple[str, int, bool]] = []  # element, zone inside, under comments
    zone, comments = OPEN, False
    text: list[str] = []

    def end_block() -> None:
        nonlocal text
        joined = " ".join(html.unescape("".join(text)).split())
        text = []
        if joined:
            if found and found[-1][0] == zone != OPEN:
                found[-1][1].append(joined)
            else:
                found.append((zone, [joined]))

    at, size = 0, len(page)
    while at < size:
        mark = _MARK.search(page, at)
        if mark is None:
            text.append(page[at:])
            break
        if mark.start() > at:
            text.append(page[at : mark.start()])
        at = mark.end()
        name = mark[2] or mark[5]
        if name is None:
            continue
        closing, attributes = mark[1] or mark[4], mark[3] or mark[6] or ""
        name = name.lower()
        if closing:
            if name not in _INLINE:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in _INLINE and any(e not in _INLINE for e, _, _ in stack[i + 1 :]):
                        break  # an inline end tag doesn't close blocks
                    if i + 1 < len(stack) or stack[i][1] != (stack[i - 1][1] if i else OPEN):
                        end_block()
                    del stack[i:]
                    zone, comments = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
                    break
            continue
        if name in _RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name not in _INLINE:
            end_block()
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _ENDS_SAME and stack and name in (stack[-1][0], *(e for e, _, _ in stack[-2:])):
            while stack.pop()[0] != name:
                pass
            zone, comments = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
        words, role = _hints(attributes) if "=" in attributes else (set(), "")
        inner, under = zone, comments
        if name in ("article", "main") or role in ("article", "main"):
            if words & _COMMENTS or under:
                inner, under = CHROME, True
            else:
                inner = MAIN if not any(e in _DROPPED and e not in _FORMS for e, _, _ in stack) else zone
        elif name == "header" and zone == MAIN and any(e == "article" for e, _, _ in stack):
            pass  # the article's own heading
        elif name == "form" and all(e in ("html", "body") for e, _, _ in stack):
            pass  # some servers wrap the whole page in a form; its fields are dropped on their own
        elif name in _DROPPED or role in _ROLES:
            inner = CHROME
        elif name not in ("html", "body") and words:
            inner, under = CHROME, under or bool(words & _COMMENTS)
        if inner != zone:
            end_block()
        stack.append((name, inner, under))
        zone, comments = inner, under
    end_block()
    return [(z, " ".join(pieces)) for z, pieces in found]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _BASE
    return x ^ (x >> np.uint64(29))


def _codes(words: np.ndarray, host: np.ndarray, size: int) -> np.ndarray:
    """A code for every ``size`` tokens in a row and the host of the first; tokens and hosts are given as hashes."""
    n = max(0, len(words) - size + 1)
    out = host[:n].copy()
    for i in range(size):
        out = (out ^ (out >> np.uint64(29))) * _BASE + words[i : i + n]
    return _mix(out)


def _starts(page: np.ndarray, run: int) -> np.ndarray:
    """Where runs start that don't leave their page."""
    return np.flatnonzero(page[: max(0, len(page) - run + 1)] == page[run - 1 :])


def _sketches(words: np.ndarray, host: np.ndarray, run: int) -> np.ndarray:
    """For every run the least code of a few of its tokens: equal runs have equal ones."""
    size = min(run, SKETCH)
    codes = _codes(words, host, size)
    n = max(0, len(words) - run + 1)
    least = codes[:n].copy()
    for i in range(1, run - size + 1):
        np.minimum(least, codes[i : i + n], out=least)
    return _mix(least)


def _counts(codes: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes by size and the number of pages of each; pages come in rising order."""
    order = np.argsort(codes, kind="stable")
    codes, page = codes[order], page[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new_page = new.copy()
    new_page[1:] |= page[1:] != page[:-1]
    first = np.flatnonzero(new)
    return codes[first], np.add.reduceat(new_page.astype(np.int64), first) if len(first) else first


def _marks(n: int, at: np.ndarray, run: int) -> np.ndarray:
    """Marks the ``run`` tokens from each place."""
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + run] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, host: np.ndarray, run: int = RUN, pages: int = PAGES) -> np.ndarray:
    """Marks tokens inside a run of ``run`` tokens that lies in ``pages`` pages or more of its host.

    Suffixes are sorted by the code of their host and first ``run`` tokens; a suffix that leaves its page before that has no run.
    """
    start = _starts(page, run)
    codes = _codes(_mix(tokens.astype(np.uint64) + np.uint64(1)), _mix(~host.astype(np.uint64)), run)[start]
    found, n = _counts(codes, page[start])
    return _marks(len(tokens), start[np.isin(codes, found[n >= pages])], run)


def _parts(id_type: pa.DataType):
    """Packs pages, as zones and texts of their blocks, into one row per part."""
    kinds = pa.schema([
        ("page_id", id_type), ("url", pa.string()), ("host", pa.string()), ("zones", pa.list_(pa.int8())), ("texts", pa.list_(pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        tokens = number = 0
        task = TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            ids, *columns = zip(*rows, strict=True)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kinds, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                columns = [pa.array(c, k) for c, k in zip(columns, kinds.types[1:], strict=True)]
                out.write_batch(pa.record_batch([pa.array(ids, id_type), *columns], schema=kinds))
            data = sink.getvalue().to_pybytes()
            return pa.record_batch({
                "part": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()),
                "key": pa.array([xxhash.xxh64_intdigest(data) - (1 << 63)], pa.int64()), "pages": pa.array([data], pa.binary()),
            })

        for batch in batches:
            for page_id, url, host, page in zip(*(batch.column(c) for c in ("page_id", "url", "host", "html")), strict=True):
                found = blocks_of(page.as_py() or "")
                rows.append((page_id.as_py(), url.as_py(), host.as_py(), [z for z, _ in found], [t for _, t in found]))
                tokens += sum(t.count(" ") + 1 for _, t in found)
                if tokens >= PART_TOKENS or len(rows) >= PART_PAGES:
                    yield done()
                    rows, tokens, number = [], 0, number + 1
        if rows:
            yield done()

    return run


def _read(data: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """The pages of a part, and of all their tokens the hash, the page and the host's hash."""
    pages = pa.ipc.open_stream(data).read_next_batch()
    number: dict[str, int] = {}
    words = []
    for texts in pages.column("texts"):
        words.append(np.array([number.setdefault(w, len(number)) for t in texts for w in t.as_py().split()], np.int64))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in number), np.uint64, len(number))
    hosts = np.fromiter((xxhash.xxh64_intdigest(h, 1) for h in pages.column("host").to_pylist()), np.uint64, len(words))
    page = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return pages, hashes[np.concatenate(words)], page, hosts[page]


_LISTS = "bucket long, part int, number int, key long, codes binary, times binary"
_ANSWERS = "part int, number int, key long, codes binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _told(row: dict) -> np.ndarray:
    """The repeated codes that the buckets answered a part."""
    if any(a["key"] != row["key"] for a in row["answers"] or ()):
        raise RuntimeError("the pages were read in another order the second time")
    return np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unpacked(a["codes"]), dtype=np.uint64) for a in row["answers"] or ())])


def _lists(run: int, pages: int, bits: int, short: int, sketches: bool):
    """Lists the codes of each part per bucket: of sketches, or of the runs whose sketch is repeated."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, words, page, host = _read(row["pages"])
            start = _starts(page, run)
            codes, width = _sketches(words, host, run)[start] >> np.uint64(64 - short), short
            if not sketches:
                start = start[np.isin(codes, _told(row))]
                codes, width = _codes(words, host, run)[start], 64
            codes, times = _counts(codes, page[start])
            bucket = (codes >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(codes), np.int64)
            first = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            spans = list(zip(first, [*first[1:], len(bucket)], strict=False))
            yield pa.record_batch({
                "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
                "part": pa.array([row["part"]] * len(spans), pa.int32()),
                "number": pa.array([row["number"]] * len(spans), pa.int32()),
                "key": pa.array([row["key"]] * len(spans), pa.int64()),
                "codes": pa.array([packed(np.diff(codes[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
                "times": pa.array([packed(np.minimum(times[a:b], pages)) for a, b in spans], pa.binary()),
            })
            release_memory()

    return make


def _answer(pages: int):
    """The codes of each list that lie in enough pages of all parts; rows come sorted by bucket."""

    def done(held: list[dict]) -> pa.RecordBatch:
        lists = [np.cumsum(unpacked(r["codes"]), dtype=np.uint64) for r in held]
        times = np.concatenate([unpacked(r["times"]) for r in held]).astype(np.int64)
        codes, number = np.unique(np.concatenate(lists), return_inverse=True)
        often = (np.bincount(number, times) >= pages)[number]
        ends = np.cumsum([len(x) for x in lists])[:-1]
        told = [(r, x[o]) for r, x, o in zip(held, lists, np.split(often, ends), strict=True) if o.any()]
        return pa.record_batch({
            "part": pa.array([r["part"] for r, _ in told], pa.int32()),
            "number": pa.array([r["number"] for r, _ in told], pa.int32()),
            "key": pa.array([r["key"] for r, _ in told], pa.int64()),
            "codes": pa.array([packed(np.diff(x, prepend=np.uint64(0))) for _, x in told], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and held[0]["bucket"] != row["bucket"]:
                yield done(held)
                held = []
            held.append(row)
        if held:
            yield done(held)
        release_memory()

    return run


def _texts(pages: pa.RecordBatch, marked: np.ndarray) -> Iterator[tuple[str, int]]:
    """Main text and number of repeated tokens of each page of a part."""
    at = 0
    for zones, texts in zip(pages.column("zones"), pages.column("texts"), strict=True):
        main, unique, plain = [], [], []
        first = at
        for zone, text in zip(zones.as_py(), texts.as_py(), strict=True):
            size = text.count(" ") + 1
            if zone == MAIN:
                main.append(text)
            elif zone == OPEN:
                plain.append(text)
                unique += [w for w, m in zip(text.split(), marked[at : at + size].tolist(), strict=True) if not m]
            at += size
        # a page all of whose open blocks repeat is a copy: its text stays
        yield " ".join(main or unique or plain), int(marked[first:at].sum())


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", run: int = RUN, in_pages: int = PAGES
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_repeated.

    ``n_repeated`` counts the page's tokens in runs repeated on its host, however many pages that has. Null and empty pages have an
    empty text. A null url is a host of its own. Repeated rows and null ids keep their row and count as pages of their own, an empty
    table gives an empty result, and other columns are not looked at.
    """
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.col(f"`{page}`").alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)).alias("host"),
    )
    tokens = (rows.agg(F.sum(F.octet_length("html")).alias("n")).first()["n"] or 0) / 8
    bits = max(0, math.ceil(math.log2(max(1, tokens / BUCKET_RUNS))))
    short = min(64, math.ceil(math.log2(max(1, tokens))) + SPARE_BITS)
    id_type = to_arrow_type(rows.schema["page_id"].dataType)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            held, words, page, host = _read(row["pages"])
            start = _starts(page, run)
            at = start[np.isin(_codes(words, host, run)[start], _told(row))]
            texts, counts = zip(*_texts(held, _marks(len(words), at, run)), strict=True)
            yield pa.record_batch({
                "page_id": held.column("page_id"), "url": held.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_repeated": pa.array(counts, pa.int64()),
            })
            release_memory()

    # shuffled once: all three readers below share this exchange
    parts = rows.mapInArrow(_parts(id_type), "part int, number int, key long, pages binary").repartition("part", "number")

    def answered(lists: DataFrame) -> DataFrame:
        """The parts, each with what the buckets answer to its lists."""
        dealt = lists.repartition("bucket").sortWithinPartitions("bucket")
        answers = dealt.mapInArrow(_answer(in_pages), _ANSWERS).groupBy("part", "number").agg(F.collect_list(F.struct("key", "codes")).alias("answers"))
        return parts.join(answers, ["part", "number"], "left")

    sketched = answered(parts.mapInArrow(_lists(run, in_pages, bits, short, True), _LISTS))
    met = answered(sketched.mapInArrow(_lists(run, in_pages, bits, short, False), _LISTS))
    kind = dict(rows.dtypes)["page_id"]
    return met.mapInArrow(finish, f"page_id {kind}, url string, text string, n_chars long, n_repeated long")
