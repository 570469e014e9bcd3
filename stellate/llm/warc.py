"""WARC archives with revisit resolution.

Headers are shuffled by payload digest, without payloads, to find the record
every digest is kept under. Payloads meet that list by (digest, id), a key that no
group of copies makes hot, and only the kept ones are written; every other record becomes a
revisit whose header names the response. The writer is Spark's text sink with the record end as its
line separator, so archives go wherever Spark can write.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.llm.common import utf8

#: Bytes of payload aimed at per archive file, by the mean size; readers stream, so a file of large pages is none too many.
FILE_BYTES = 8 << 20
_END = "\r\n\r\n"
_BLANK = _END.encode()
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits become four base32 digits, eight times."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null is left out."""
    lines = [F.concat(F.lit(f"\r\n{name}: "), value) for name, value in fields]
    return F.concat(F.lit("WARC/1.0"), *[F.coalesce(line, F.lit("")) for line in lines], F.lit(_END))


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), digest, F.lit(">"))


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0
) -> None:
    """Writes one record per row: a response per distinct payload, revisits for its other rows.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the response; null
    ids come last. Rows that repeat both that id and the payload are all responses. A null payload is empty, a null
    url leaves its field out, and white space and control characters in a url become %20. No rows give no records.
    """
    content = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.regexp_replace(F.col(f"`{url}`"), r"[\x00-\x20\x7F]+", "%20").alias("url"),
        content.alias("payload"),
        sha1_base32(content.cast("binary")).alias("digest"),
        F.octet_length(content).cast("long").alias("size"),
    )
    headers = rows.drop("payload")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))
    kept = headers.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    kept = kept.select(F.col("digest").alias("k_digest"), F.col("first.id").alias("k_id"), "n")
    small = F.col("size") < least_bytes

    same_row = (F.col("digest") == F.col("k_digest")) & F.col("page_id").eqNullSafe(F.col("k_id"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    common = (
        ("WARC-Date", now),
        ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("Page-ID", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    )
    block = F.concat(F.lit(_HTTP), F.col("payload"))
    responses = rows.join(kept, same_row, "left").where(F.col("k_digest").isNotNull() | small).select(
        F.concat(
            _header(("WARC-Type", F.lit("response")), *common, ("Content-Length", F.octet_length(block).cast("string"))),
            block,
        ).alias("value")
    )
    copies = headers.join(kept.where("n > 1"), F.col("digest") == F.col("k_digest"))
    revisits = copies.where(~F.col("page_id").eqNullSafe(F.col("k_id")) & ~small).select(
        F.concat(
            _header(
                ("WARC-Type", F.lit("revisit")),
                *common,
                ("WARC-Profile", F.lit(_PROFILE)),
                ("WARC-Refers-To", _record_id(F.col("k_id"), F.col("digest"))),
                ("Content-Length", F.lit(str(len(_HTTP)))),
            ),
            F.lit(_HTTP),
        ).alias("value")
    )
    mean = rows.agg((F.sum("size") / F.count("*")).alias("mean")).first()["mean"] or 0
    (
        responses.unionByName(revisits)
        .write.option("lineSep", _END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 512))))
        .text(path)
    )


class Records:
    """Puts records together from an archive's text, which comes cut at blank lines: a header up to its first one, then
    as many bytes as its Content-Length says, whatever blank lines or headers a payload holds."""

    def __init__(self) -> None:
        self._held: list[bytes] = []
        self._size = 0
        self._fields: dict[str, str] | None = None

    def take(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records that this piece ends."""
        self._held += (piece, _BLANK)
        self._size += len(piece) + len(_BLANK)
        while True:
            if self._fields is None:
                text = b"".join(self._held)
                end = text.find(_BLANK)
                if end < 0:
                    return
                lines = text[:end].decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record starts with {lines[0][:80]!r}")
                self._fields = dict(line.split(": ", 1) for line in lines[1:])
                self._keep(text[end + len(_BLANK) :])
            need = int(self._fields["Content-Length"])
            if self._size < need + len(_BLANK):
                return
            text = b"".join(self._held)
            if text[need : need + len(_BLANK)] != _BLANK:
                raise ValueError("a record is longer than its header says")
            fields, self._fields = self._fields, None
            self._keep(text[need + len(_BLANK) :])
            yield fields, text[:need]

    def _keep(self, rest: bytes) -> None:
        self._held, self._size = [rest] if rest else [], len(rest)

    def end(self) -> None:
        if self._fields is not None or b"".join(self._held) not in (b"", _BLANK):
            raise ValueError("an archive ends inside a record")
        self._keep(b"")


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an unpacked archive."""
    records = Records()
    if content:
        yield from records.take(content.removesuffix(_BLANK))
    records.end()


_READ = "page_id long, url string, record_type string, digest string, refers_to string, payload_bytes long, payload_sha1 string, payload binary"
_ROWS_AT_ONCE, _BYTES_AT_ONCE = 2000, 4 << 20


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record; lengths and digests of responses are taken from the payload itself.

    Archives are unpacked as streams, so a task holds one record and a batch of rows, however large a file is.
    """

    def row_of(fields: dict[str, str], block: bytes) -> dict:
        body = block[block.index(b"\r\n\r\n") + 4 :]
        whole = fields["WARC-Type"] == "response"
        return {
            "page_id": int(fields["Page-ID"]) if "Page-ID" in fields else None,
            "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"],
            "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "refers_to": fields.get("WARC-Refers-To"),
            "payload_bytes": len(body) if whole else None,
            "payload_sha1": base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None,
            "payload": body if whole and payloads else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, file, rows, size = Records(), None, [], 0
        for batch in batches:
            for where, piece in zip(batch.column("file"), batch.column("value"), strict=True):
                if where.as_py() != file:  # a packed archive is one split, its pieces come in order
                    records.end()
                    file = where.as_py()
                for fields, block in records.take(piece.as_py()):
                    rows.append(row_of(fields, block))
                    size += len(block) if payloads else 0
                    if len(rows) >= _ROWS_AT_ONCE or size >= _BYTES_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        records.end()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    pieces = spark.read.option("lineSep", _END).text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, _READ)


_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()),
    ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("payload", pa.binary()),
])


def resolve(records: DataFrame) -> DataFrame:
    """Every record with the length, digest and id of the payload it stands for; revisits get them from their response."""
    responses = records.where("record_type = 'response'")
    originals = responses.groupBy(F.col("digest").alias("o_digest")).agg(
        F.min("page_id").alias("o_id"),
        F.first("payload_bytes").alias("o_bytes"),
        F.first("payload_sha1").alias("o_sha1"),
    )
    revisits = records.where("record_type = 'revisit'").join(originals, F.col("digest") == F.col("o_digest"))
    return responses.select(
        "page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(revisits.select(
        "page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_sha1").alias("payload_digest"), "record_type",
        F.nullif(F.split(F.col("refers_to"), ":")[2], F.lit("none")).cast("long").alias("refers_to"),
    ))
