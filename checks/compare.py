"""Run registered queries against their oracle SQL.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value: object) -> str:
    if value is None or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, (bool, float, int, str)):
        return f"{type(value).__name__}:{value!r}"
    if isinstance(value, (decimal.Decimal, datetime.date)):
        return f"{type(value).__name__}:{value}"
    return repr(value)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides hold the same rows, else what differs first."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical(names, cursor.fetchall())
    ours = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if ours == theirs:
        return None
    extra = [r for r in ours if r not in set(theirs)][:3]
    missing = [r for r in theirs if r not in set(ours)][:3]
    return f"rows {len(ours)} vs {len(theirs)} {sorted(names)}\n   spark {extra}\n   duck  {missing}"


def main(argv: list[str]) -> int:
    from stellate.session import local_session

    sf_dir, wanted = argv[0], argv[1:] or list(QUERIES)
    spark = local_session("compare", cores=os.environ.get("CORES", "8"))
    con = duck(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            result = difference(df, con, ORACLE[name]) if name in ORACLE else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result is not None and name in ORACLE
        print(f"{'ok ' if result is None else 'BAD'} {name} {time.time() - start:.2f}s {result or ''}", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} match")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
