"""One registered query per corpus operator, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from stellate.llm import (
    decontaminate, dual_tree, html_extract, language, licenses, line_quality, lm_score, packing, private_data, rule_ensemble, simhash,
    token_align, warc,
)
from stellate.llm.common import bounded, table
from stellate.session import scratch_path

TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = bounded(build)
        return build

    return register


@query("op9_simhash_near_duplicates")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@query("op7_warc_revisits")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolve(warc.read_archives(spark, path))


@query("op8_line_quality")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.assess_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_license_scan")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op10_language_spans")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def vocabulary(name: str = TOKENIZER) -> str:
    """The content of a public tokenizer's file."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


@query("op2_packed_sequences")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=2, length=4096)


@query("op3_quality_rules")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_benchmark_leaks")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_html_main_text")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op4_stupid_backoff")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return token_align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), pieces)


@query("op12_private_spans")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.identify(table(spark, sf_dir, "documents"))


@query("op13_ranked_search")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


ORACLE["op13_ranked_search"] = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS row, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
lengths AS (SELECT row, COUNT(*) AS n FROM words GROUP BY row),
corpus AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS terms FROM lengths),
wanted AS (
  SELECT DISTINCT row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS row FROM benchmark)),
counts AS (SELECT row, doc_id, term, COUNT(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY row, doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM counts, corpus GROUP BY term, docs),
impacts AS (
  SELECT c.row, c.doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS s
  FROM counts c JOIN lengths USING (row) JOIN weights USING (term), corpus),
scores AS (
  SELECT q.row AS item, q.item_id, i.row, i.doc_id, CAST(SUM(s) AS BIGINT) AS score
  FROM wanted q JOIN impacts i USING (term) GROUP BY q.row, q.item_id, i.row, i.doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLE["op7_warc_revisits"] = """
WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha1(COALESCE(html, '')) AS h FROM pages),
f AS (SELECT h, MIN(page_id) AS first_id FROM p GROUP BY h),
d AS (
  SELECT h, first_id, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1), 1)), '') AS payload_digest
  FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN d USING (h)
"""
