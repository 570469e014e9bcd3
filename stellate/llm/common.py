"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
_LIBC = ctypes.CDLL(None)
_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes above 0x7F, with A-Z lower-cased."""
    return text.translate(_KEEP).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str) -> Column:
    """A text column as its UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))


def crc_of_id(doc_id: str) -> Column:
    """crc32 of an id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary"))


def unique_prefix(df: DataFrame, stem: str) -> str:
    """A column name that no column of the frame has, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def bounded(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``run(spark, ...)`` with Arrow batches of at most BATCH_BYTES: Spark's default of 10,000 rows or 64 MB a batch, times the
    copies that a batch has on its way, is too much for executors that hold whole texts."""

    @functools.wraps(run)
    def with_small_batches(spark: SparkSession, *args: object) -> DataFrame:
        now = str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return run(spark, *args)

    return with_small_batches


def release_memory() -> None:
    """Hands back what this worker's allocators keep after a batch: idle workers share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def struct_array(names: list[str], arrays: list[pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(arrays, names)
