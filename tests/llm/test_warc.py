from __future__ import annotations

import base64
import hashlib

import pytest

from stellate.llm import warc
from stellate.session import scratch_path

PAGE = "page_id long, url string, html string"
ROWS = [
    (5, "http://a/1", "<p>same</p>"), (3, "http://a/2", "<p>same</p>"), (9, "http://a b/\r\n3", "<p>same</p>"),
    (1, None, None), (2, "http://e", ""), (4, "http://t", "WARC/1.0\r\nContent-Length: 3\r\n\r\nx\r\n\r\n"), (6, "http://u", "é漢😀\x00\n"),
    (7, "http://l", "x" * 300_000), (None, "http://n", "<p>same</p>"), (None, None, "<p>alone</p>"),
]


def digest(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least_bytes=0):
    out = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        first = min((p for p in same if p is not None), default=None)
        size = len((html or "").encode())
        revisit = page != first and size >= least_bytes
        out.append((page, size, digest(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least_bytes", [0, 1, 100])
def test_round_trip(spark, least_bytes):
    path = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame(ROWS, PAGE).selectExpr("*", "'x' AS digest", "1 AS size").repartition(3)
    warc.write_archives(pages, path, least_bytes=least_bytes)
    records = warc.read_archives(spark, path, payloads=True)
    got = warc.resolve(records).collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS, least_bytes)
    held = [bytes(r["payload"]).decode() for r in records.where("record_type = 'response'").collect()]
    assert {(h or "") for _, _, h in ROWS} == set(held)
    if least_bytes == 0:
        assert len(held) == len(set(held))  # each payload is stored once


def test_hot_payload_is_stored_once(spark):
    path = scratch_path(spark, "warc-test")
    rows = [(i, f"http://h/{i}", "<p>copy</p>" if i % 3 == 0 else f"<p>{i}</p>") for i in range(900)]
    warc.write_archives(spark.createDataFrame(rows, PAGE).repartition(7), path)
    got = warc.resolve(warc.read_archives(spark, path)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_rows_that_repeat_an_id_and_payload_are_all_responses(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "x")], PAGE), path)
    got = warc.resolve(warc.read_archives(spark, path)).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_no_pages(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], PAGE), path)
    assert warc.resolve(warc.read_archives(spark, path)).collect() == []


def test_many_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    path = scratch_path(spark, "warc-test")
    rows = [(i, "http://h", f"<p>{i}</p>" * 10) for i in range(100)]
    warc.write_archives(spark.createDataFrame(rows, PAGE), path)
    assert spark.read.format("binaryFile").load(path).count() > 10
    assert sorted(map(tuple, warc.resolve(warc.read_archives(spark, path)).collect()), key=repr) == expected(rows)


def test_large_pages_among_small_ones_and_blank_lines(spark):
    """A file's size is set by the mean; readers hold a record, whatever the payloads hold."""
    path = scratch_path(spark, "warc-test")
    odd = ["\r\n\r\n", "\r\n\r\n\r\n", "\r\n\r\r\n\r\n", "\n\n", "\r", "a\r\n\r\nWARC/1.0\r\n\r\n", "\r\n", "x\r\n\r"]
    rows = [(i, "u", odd[i] if i < len(odd) else "y" * (2_000_000 if i % 50 == 0 else 5) + str(i)) for i in range(200)]
    warc.write_archives(spark.createDataFrame(rows, PAGE).coalesce(1), path)
    records = warc.read_archives(spark, path, payloads=True)
    held = {r["page_id"]: bytes(r["payload"]).decode() for r in records.collect()}
    assert held == {i: h for i, _, h in rows}
    assert sorted(map(tuple, warc.resolve(records).collect()), key=repr) == expected(rows)


def test_cut_archives_are_noticed():
    header = "WARC/1.0\r\nContent-Length: 5\r\n\r\n"
    assert list(warc.parse_records((header + "ab\r\nc\r\n\r\n").encode())) == [({"Content-Length": "5"}, b"ab\r\nc")]
    for text in (header + "abc", header + "abcdefgh\r\n\r\n", "HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(text.encode()))
