"""Writing layers: validate first, publish after, always safe to run again.

A run's manifest keeps what was learnt while its tables were written: rows, files, named totals, least and
greatest values, and the schema, so that no file has to be opened to plan a read. Gates and views take these from the manifest instead of scanning what has just been written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stellate.functions.literals import literal_table


class RowCountMismatch(RuntimeError):
    pass


class MissingFiles(RuntimeError):
    pass


@dataclass(frozen=True)
class Landing:
    """A frame to land, with the row count its source promises (None: no promise).

    A frame that builds on a table of the same layer is given as a function of
    a reader for the tables written so far, so that nothing is computed twice.

    ``totals`` are named aggregates over the rows, ``extremes`` columns whose least and greatest value is wanted; both are taken
    while the rows are written. ``order_by`` lays rows out in ranges of these columns (after the folders), so that the files' and row groups'
    statistics tell most of them apart; it should end in a column with many values, for a range splits no equal keys.
    ``bucket_by`` deals rows by a hash of a column into ``buckets`` files that later joins and groupings on it take as they are;
    ``dealt`` says that the frame's own last shuffle dealt them so.
    """

    frame: DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]
    expected_rows: int | None = None
    partition_by: tuple[str, ...] = ()
    totals: Mapping[str, Column] = field(default_factory=dict)
    extremes: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    bucket_by: str | None = None
    buckets: int = 0
    dealt: bool = False


@dataclass(frozen=True)
class TableFacts:
    """What a manifest says of one table; totals are numbers as text, extremes plain values."""

    rows: int
    files: int
    schema: str
    totals: dict[str, str | None] = field(default_factory=dict)
    least: dict[str, int | str | None] = field(default_factory=dict)
    greatest: dict[str, int | str | None] = field(default_factory=dict)
    bucket_by: str | None = None
    buckets: int = 0


#: Rows of a bucket, and buckets of a table at least and at most (Spark's own limit is 100,000).
BUCKET_ROWS, FEWEST_BUCKETS, MOST_BUCKETS = 2_000_000, 8, 1 << 16


def buckets_for(rows: int) -> int:
    """A power of two, so that tables of different sizes still fit into each other's buckets."""
    return min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length()))


#: Reads a table of one run.
Reader = Callable[[str], DataFrame]


class Run:
    """Reads the tables of one run. ``facts`` is its manifest; a table that lost files since it was written can't be read."""

    def __init__(self, spark: SparkSession, root: str, run: str, facts: dict[str, TableFacts] | None = None) -> None:
        self.spark, self._root, self.run = spark, root, run
        if facts is not None:
            self.facts = facts

    @cached_property
    def facts(self) -> dict[str, TableFacts]:
        """Empty for a run without a manifest."""
        path = f"{self._root}/manifests/run={self.run}"
        if not _exists(self.spark, path):
            return {}
        lines = self.spark.read.text(path).collect()  # a line per table
        held = (json.loads(r["value"]) for r in lines)
        return {h.pop("table"): TableFacts(**h) for h in held}

    def path(self, table: str) -> str:
        return f"{self._root}/run={self.run}/{table}"

    def __call__(self, table: str) -> DataFrame:
        known = self.facts.get(table)
        if known is None:
            return self.spark.read.parquet(self.path(table))
        frame = self.spark.read.schema(StructType.fromJson(json.loads(known.schema))).parquet(self.path(table))
        there = len(frame.inputFiles())  # from the listing that the read needs anyway
        if there != known.files:
            raise MissingFiles(f"{table} of run {self.run} has {there} of {known.files} files")
        return self._bucketed(frame, table, known) if known.bucket_by else frame

    def _bucketed(self, frame: DataFrame, table: str, known: TableFacts) -> DataFrame:
        """The table under a name of its own in the session's catalogue, which is where Spark keeps how files are dealt."""
        name = f"stellate_{table}_{self.run}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (`{known.bucket_by}`) SORTED BY (`{known.bucket_by}`) INTO {known.buckets} BUCKETS LOCATION '{self.path(table)}'"
        )
        return self.spark.table(name)


def publish_layer(
    spark: SparkSession,
    root: str,
    tables: Mapping[str, Landing],
    check: Callable[[Reader], object] | None = None,
) -> dict[str, int]:
    """Write all tables of a layer into a new run folder and switch to it only if everything holds.

    Counts and totals are taken while writing; ``check`` then sees the written tables and their facts, and
    raises if they must not be published. Partitioned tables are rebalanced by their
    folders first, which splits a large folder over tasks and keeps small ones
    from turning into a file per task. If a count or the check fails nothing is
    published and the previous run stays current.
    """
    run = uuid.uuid4().hex
    facts: dict[str, TableFacts] = {}
    bad: list[str] = []
    written = Run(spark, root, run, facts)

    for name, landing in tables.items():
        frame = landing.frame if isinstance(landing.frame, DataFrame) else landing.frame(written)
        facts[name] = _write(frame, name, landing, written)
        if landing.expected_rows is not None and facts[name].rows != landing.expected_rows:
            bad.append(f"{name}: got {facts[name].rows:,}, expected {landing.expected_rows:,}")
    if bad:
        raise RowCountMismatch("; ".join(bad))
    if check is not None:
        check(written)
    lines = [(json.dumps({"table": name, **asdict(f)}),) for name, f in facts.items()]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{root}/manifests/run={run}")
    _switch(spark, root, run)
    return {name: f.rows for name, f in facts.items()}


def _write(frame: DataFrame, name: str, landing: Landing, run: Run) -> TableFacts:
    """Lays rows out, then counts them on their way into the files: behind the last shuffle, where a task's counts are taken
    once, when it succeeds, however often rows before it have to be made anew."""
    if landing.bucket_by and landing.dealt:
        pass
    elif landing.bucket_by:
        frame = frame.repartition(landing.buckets, F.col(landing.bucket_by)).sortWithinPartitions(landing.bucket_by)
    elif landing.order_by:
        order = [F.col(c) for c in (*landing.partition_by, *landing.order_by)]
        frame = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    elif landing.partition_by:
        frame = frame.hint("rebalance", *[F.col(c) for c in landing.partition_by])
    seen = Observation(f"{name}_{run.run}")
    watched = {f"total_{t}": c for t, c in landing.totals.items()}
    watched |= {f"{w}_{c}": f(F.col(c)) for c in landing.extremes for w, f in (("least", F.min), ("greatest", F.max))}
    frame = frame.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in watched.items()])
    writer = frame.write.mode("overwrite")
    if landing.partition_by:
        writer = writer.partitionBy(*landing.partition_by)
    if landing.bucket_by:
        table = f"stellate_writing_{name}_{run.run}"
        writer.bucketBy(landing.buckets, landing.bucket_by).sortBy(landing.bucket_by).option("path", run.path(name)).saveAsTable(table)
        run.spark.sql(f"DROP TABLE {table}")  # the files stay; readers name them anew
    else:
        writer.parquet(run.path(name))
    got = seen.get
    plain = lambda v: v if v is None or isinstance(v, int) else str(v)
    return TableFacts(
        rows=got["rows"],
        files=len(run.spark.read.schema(frame.schema).parquet(run.path(name)).inputFiles()),
        schema=json.dumps(_nullable(frame, landing.partition_by).jsonValue()),
        totals={t: None if got[f"total_{t}"] is None else str(got[f"total_{t}"]) for t in landing.totals},
        least={c: plain(got[f"least_{c}"]) for c in landing.extremes},
        greatest={c: plain(got[f"greatest_{c}"]) for c in landing.extremes},
        bucket_by=landing.bucket_by,
        buckets=landing.buckets if landing.bucket_by else 0,
    )


def _nullable(frame: DataFrame, folders: Sequence[str]) -> StructType:
    """The schema as files give it back: folders last, anything may be NULL."""
    fields = [*[f for f in frame.schema.fields if f.name not in folders], *[frame.schema[c] for c in folders]]
    return StructType([StructField(f.name, f.dataType, True) for f in fields])


def totals_of(read: Reader, table: str) -> DataFrame | None:
    """One row with a written table's totals, without a scan; None where no manifest has them."""
    known = getattr(read, "facts", {}).get(table)
    if known is None or not known.totals:
        return None
    spark = read.spark
    return literal_table(spark, [list(known.totals.values())], ", ".join(f"`{t}` decimal(38,2)" for t in known.totals))


def _switch(spark: SparkSession, root: str, run: str) -> None:
    """A new pointer next to the older ones: pointers are written once and never changed.

    Until its one file is in place readers see the pointer before it. Two
    publishers of the same layer cannot both take a number: the second write fails.
    """
    known = published_runs(spark, root)
    number = known[-1][0] + 1 if known else 1
    pointer = literal_table(spark, [(run,)], "run string")
    pointer.write.mode("errorifexists").text(f"{root}/pointers/number={number}")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    system, at = _file_system(spark, path)
    return system.exists(at)


def published_runs(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, run) of every published run, the current one last. One small file per run."""
    if not _exists(spark, f"{root}/pointers"):
        return []
    pointers = spark.read.schema("value string, number long").text(f"{root}/pointers")
    return sorted((r["number"], r["value"]) for r in pointers.collect())


def remove_old_runs(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Deletes the tables, manifests and pointers of all published runs but the last ``keep``; returns the runs removed.

    For a time when no reader holds an older run. Pointers go first and from the oldest on, so a run is never current without its tables.
    Runs that were never published (a failed check) are not listed anywhere and stay.
    """
    if keep < 1:
        raise ValueError("the current run stays")
    old = published_runs(spark, root)[:-keep]
    for number, run in old:
        for path in (f"{root}/pointers/number={number}", f"{root}/run={run}", f"{root}/manifests/run={run}"):
            system, at = _file_system(spark, path)
            system.delete(at, True)
    return [run for _, run in old]


def open_published(spark: SparkSession, root: str) -> Run:
    """A reader for the tables of the run that is current now; later runs don't change what it reads."""
    runs = published_runs(spark, root)
    if not runs:
        raise FileNotFoundError(f"nothing is published below {root}")
    return Run(spark, root, runs[-1][1])


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of the current run; for several of one run use ``open_published``."""
    return open_published(spark, root)(table)


def register_views(tables: Mapping[str, DataFrame], prefix: str) -> None:
    """Expose frames to SQL users as <prefix>_<table>."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(f"{prefix}_{name}")


def export_csv(mart: DataFrame, path: str, order: Sequence[str]) -> None:
    """One file with a header, text quoted, numbers bare and NULL left empty, rows in the given order.

    For marts, whose size is bounded by their grain: the rows meet in one task
    only after the mart has been computed.
    """

    def field(f: StructField) -> Column:
        value = F.col(f"`{f.name}`").cast("string")
        if f.dataType == StringType():
            value = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(value, F.lit(""))

    header = ",".join(f'"{name}"' for name in mart.columns)
    line = F.concat_ws(",", *[field(f) for f in mart.schema.fields])
    lines = mart.select(F.lit(1).alias("_part"), line.alias("value"), *order)
    first = lines.limit(0).unionByName(
        literal_table(mart.sparkSession, [(0, header)], "_part int, value string"), allowMissingColumns=True
    )
    ordered = first.unionByName(lines).repartition(1).sortWithinPartitions("_part", *order)
    ordered.select("value").write.mode("overwrite").text(path)
