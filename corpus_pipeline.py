"""From raw documents to packed training sequences, one operator per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stellate.llm import decontaminate, language, line_quality, packing, simhash
from stellate.llm.common import bounded, table
from stellate.llm.queries import vocabulary
from stellate.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose content lines hold half of their words."""
    return line_quality.keep(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language holds half of the letters."""
    return language.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: three-word shingles, at most three bits."""
    return simhash.one_of_each(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, vocabulary(), end_id=2, length=4096)


STAGES = [
    ("quality rules", bounded(quality_rules)),
    ("language ID", bounded(language_id)),
    ("SimHash near-dedup", bounded(near_dedup)),
    ("benchmark decontamination", bounded(decontamination)),
    ("packing", bounded(packed)),
]

#: Trained and iterative stages have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
