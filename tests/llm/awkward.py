"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["fp", "cell", "uid", "kept", "score", "_verdict", "_language", "_leaks", "_dropped", "component_id", "host", "tokens", "count"]

_rng = random.Random(11)
SYLLABLES = ["er", "on", "th", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]


def words(n: int, seed: int | None = None) -> str:
    rng = random.Random(seed) if seed is not None else _rng
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    out, left = [], n
    while left > 0:
        k = min(left, rng.randint(5, 12))
        out.append(words(k, rng.randrange(1 << 30)).capitalize() + ".")
        left -= k
    return "\n".join(" ".join(out[i : i + 3]) for i in range(0, len(out), 3))


def document_rows() -> list[tuple]:
    long = prose(12000, 5)
    rows = [(i, prose(80 + 7 * i, i), ["en", "de", None][i % 3], f"s{i % 2}", None) for i in range(1, 25)]
    rows += [
        (100, None, "en", None, None),
        (101, "", "en", "s", 0),
        (102, " \n\t ", None, "s", 4),
        (103, long, "en", "s", len(long)),
        (104, long + " tail", "en", "s", None),
        (105, "a", "en", "s", 1),
        (106, "Ünïcode ß ﬁ 漢字 😀 é", "de", "s", None),
        (107, "|||| ### 123 !!!", "en", "s", None),
        (108, "la la la " * 60, "en", "s", None),
        (1, prose(87, 1), "de", "s1", None),
        (200, prose(87, 1), "de", "s1", None),
        (200, prose(87, 1), "de", "s1", None),
        (None, prose(90, 77), "en", None, None),
        (None, None, None, None, None),
    ]
    return rows


def documents(spark: SparkSession, rows: list[tuple] | None = None, clashes: bool = True) -> DataFrame:
    from pyspark.sql import functions as F

    df = spark.createDataFrame(document_rows() if rows is None else rows, DOCS)
    if clashes:
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    return df.repartition(3)


def labels(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    given = [(i, int(i % 4 != 0), 0) for i in range(1, 25)] + [(108, 0, 0), (107, 0, 0), (1, 1, 0), (None, 1, 0), (3, None, 0)]
    return spark.createDataFrame(given if rows is None else rows, "doc_id long, quality int, toxic int")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
