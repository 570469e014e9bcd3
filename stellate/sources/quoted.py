"""Text whose separators may stand inside quotes, read by as many tasks as the file has splits.

A piece between two separators is whole if the quotes before it and in it are even. Quotes are counted per piece and summed inside a
split; one row per split carries the parity, and the number of records so far, from split to split of a file. Only the
pieces of records that a separator cuts meet again, by their record's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.session import cut_lineage


class MalformedSource(ValueError):
    pass


def csv_quotes(piece: Column) -> Column:
    """Quote characters; a doubled one inside quotes changes nothing."""
    return F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit("")))


def json_quotes(piece: Column) -> Column:
    """Quote characters that no backslash escapes."""
    return csv_quotes(F.regexp_replace(piece, r"(?s)\\.", ""))


def has_cut_records(pieces: DataFrame, quotes: Column) -> bool:
    return not pieces.filter(quotes % 2 == 1).limit(1).isEmpty()


def whole_records(spark: SparkSession, path: str, separator: str, quotes) -> DataFrame:
    """(file, record, value): the records of text files, numbered from 0 in each, separators in quotes kept.

    Text that ends inside quotes stops the load.
    """
    text = spark.read.option("lineSep", separator).text(path)
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # rises inside a split
        "value",
        quotes(F.col("value")).alias("quotes"),
    )
    ahead = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    run = pieces.withColumn("run", F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) + F.col("quotes"))
    even = (F.col("run") % 2 == 0).cast("long")
    # how many records end before a piece, if its split begins outside quotes and if it begins inside
    placed = cut_lineage(run.withColumn("ends_0", F.coalesce(F.sum(even).over(ahead), F.lit(0))).withColumn("ends_1", F.coalesce(F.sum(1 - even).over(ahead), F.lit(0))))
    splits = placed.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum(even).alias("ends_0"), F.sum(1 - even).alias("ends_1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = splits.withColumn("begins", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    ended = F.when(F.col("begins") == 0, F.col("ends_0")).otherwise(F.col("ends_1"))
    known = cut_lineage(parity.select("file", "block", "begins", F.coalesce(F.sum(ended).over(earlier), F.lit(0)).alias("so_far"), ((F.col("begins") + F.col("quotes")) % 2).alias("left")))
    last = known.groupBy("file").agg(F.max_by("left", "block").alias("left")).filter("left = 1").limit(1).collect()
    if last:
        raise MalformedSource(f"{last[0]['file']} ends inside quotes")
    met = placed.join(known.drop("left"), ["file", "block"]).select(
        "file", "block", "at", "value",
        (F.col("so_far") + F.when(F.col("begins") == 0, F.col("ends_0")).otherwise(F.col("ends_1"))).alias("record"),
        ((F.col("begins") + F.col("run") - F.col("quotes")) % 2 == 0).alias("starts"),
        ((F.col("begins") + F.col("run")) % 2 == 0).alias("ends"),
    )
    alone = met.filter("starts AND ends").select("file", "record", "value")
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    joined = met.filter("NOT (starts AND ends)").groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), separator).alias("value"))
    return alone.unionByName(joined)
