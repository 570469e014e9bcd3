"""Small fixed tables and maps written as constants in the plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return str(value)


def literal_map(pairs: Iterable[tuple[object, object]]) -> Column:
    """A constant map column, written as one expression."""
    return F.expr("map(" + ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in pairs) + ")")


def literal_table(spark: SparkSession, rows: Iterable[Sequence[object]], schema: str) -> DataFrame:
    """Rows as a VALUES list, so that the optimizer sees a local relation of known size."""
    fields = StructType.fromDDL(schema).fields
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(f"`{f.name}`" for f in fields)
    typed = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({columns})")


def typed_literal(value: object, kind: DataType) -> str:
    """SQL text of a value read back from a column of this type."""
    return "NULL" if value is None else f"CAST({_literal(str(value))} AS {kind.simpleString()})"


def steps_passed(value: str, steps: Sequence[object], kind: DataType, descending: bool = False) -> Column:
    """How many of the steps, in order, the column has reached: a balanced tree of comparisons, written as one expression."""
    sign = ">" if descending else "<"

    def half(first: int, last: int) -> str:
        if first == last:
            return str(first)
        middle = (first + last) // 2
        return f"CASE WHEN `{value}` {sign} {typed_literal(steps[middle], kind)} THEN {half(first, middle)} ELSE {half(middle + 1, last)} END"

    return F.expr(half(0, len(steps)))
