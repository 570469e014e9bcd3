"""File readers for the raw layer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stellate.sources import schemas
from stellate.sources.quoted import MalformedSource, csv_quotes, has_cut_records, json_quotes, whole_records

__all__ = ["MalformedSource"]


class MissingColumns(ValueError):
    pass


def require_columns(found: Iterable[str], wanted: Iterable[str]) -> None:
    missing = missing_columns(found, wanted)
    if missing:
        raise MissingColumns(f"source lacks columns: {missing}")


def missing_columns(found: Iterable[str], wanted: Iterable[str]) -> list[str]:
    found = set(found)
    return [name for name in wanted if name not in found]


_CSV = {"nullValue": "\u0001", "emptyValue": "", "escape": '"', "mode": "FAILFAST"}


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ",", line_breaks: bool = False) -> DataFrame:
    """Delimited text with a header line, read by column name.

    An unquoted empty field is NULL, a quoted one is empty text. The header is
    read first so that the file's own column order does not matter and a
    missing column stops the load; every further file must have the same header.
    With ``line_breaks`` quoted fields may hold line breaks; the text is scanned once for lines that quotes leave open, and if
    there are any, records are put together across lines and splits before they are parsed.
    """
    reader = spark.read.option("header", True).option("sep", sep).options(**_CSV)
    header = reader.option("inferSchema", False).csv(path).columns
    require_columns(header, schema.fieldNames())
    in_file = StructType([StructField(name, StringType()) for name in header])
    wanted = [F.col(f"`{f.name}`") for f in schema.fields]
    if line_breaks:
        lines = spark.read.option("lineSep", "\n").text(path)
        if has_cut_records(lines, csv_quotes(F.col("value"))):
            return _parsed(whole_records(spark, path, "\n", csv_quotes), in_file, sep).select(*wanted)
    return reader.option("enforceSchema", False).schema(in_file).csv(path).select(*wanted)


def _parsed(records: DataFrame, schema: StructType, sep: str) -> DataFrame:
    """Records without each file's header, which has to name the same columns everywhere."""
    text = F.regexp_replace("value", "\r$", "")
    fields = F.from_csv(text, ", ".join(f"`{f.name}` string" for f in schema.fields), {**_CSV, "sep": sep})
    headers = records.filter("record = 0").select(text.alias("value")).distinct().select(fields.alias("f")).select("f.*").distinct().limit(2).collect()
    if [list(h) for h in headers] != [schema.fieldNames()]:
        raise MalformedSource(f"headers differ: {[list(h) for h in headers]}, expected {schema.fieldNames()}")
    return records.filter("record > 0").filter(text != "").select(fields.alias("f")).select("f.*")


def read_card_file(spark: SparkSession, path: str) -> DataFrame:
    """Cards without the number, code and PIN date: those columns go no further than the scan."""
    kept = read_delimited(spark, path, schemas.CARDS)
    return kept.na.fill("")


def read_bills(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon file, renamed to table columns, numbers typed, dates left as text."""
    raw = read_delimited(spark, path, schemas.BILLS_FILE, sep=";")
    types = {f.name: f.dataType for f in schemas.BILLS.fields}
    return raw.select(
        *[
            F.nullif(F.col(f"`{source}`"), F.lit("")).cast(types[name]).alias(name)
            if name in schemas.BILLS_NUMBERS
            else F.col(f"`{source}`").alias(name)
            for source, name in schemas.BILLS_RENAMED.items()
        ]
    )


_SPACE = " \t\r\n"


def _read_pairs(spark: SparkSession, path: str, key: str, value: str, what: str) -> DataFrame:
    """The pairs of one JSON object of text values, bare or below "target", as rows.

    The whole file is one JSON value, which a JSON reader would hand to one task. It is split at commas instead, and pieces that
    a comma inside a text has cut are put together again. What is neither a pair nor the object's own wrapping stops the load.
    """
    pieces = spark.read.option("lineSep", ",").text(path)
    if has_cut_records(pieces, json_quotes(F.col("value"))):
        pieces = whole_records(spark, path, ",", json_quotes)
    bare = F.ltrim(F.rtrim("value", F.lit(_SPACE + "}")), F.lit(_SPACE + "{"))
    pair = F.ltrim(F.regexp_replace(bare, r'^"target"\s*:\s*\{', ""), F.lit(_SPACE))
    held = F.from_json(F.concat(F.lit("{"), F.col("pair"), F.lit("}")), "map<string,string>")
    one = F.col("pair").startswith('"') & F.col("pair").endswith('"') & (F.size(held) == 1)
    bad = F.raise_error(F.concat(F.lit(f"malformed {what} text: "), F.col("pair"))).cast("map<string,string>")
    found = pieces.select(pair.alias("pair")).filter("pair != ''")
    return found.select(F.explode(F.when(F.coalesce(one, F.lit(False)), held).otherwise(bad)).alias(key, value))


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {code: description}."""
    return _read_pairs(spark, path, "mcc", "description", "code")


def read_label_object(spark: SparkSession, path: str) -> DataFrame:
    """The nested label object {"target": {id: "Yes" | "No"}} as rows."""
    return _read_pairs(spark, path, "transaction_id", "is_fraud", "label")
