"""Parquet tables: layers, versions, upserts and incremental loads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.latest import keep_latest, replace_matching
from seriesloom.schemas import columns
from seriesloom.session import work_dir

PART, LOAD = "part_key", "load"
# A version of a table: which load holds each part.
PARTS = columns("part_key STRING, load STRING")


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class DuplicateKeys(ValueError):
    """A batch to be merged holds two rows for one key."""


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder; empty when it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, if it exists."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def from_footers(spark: SparkSession, path: str, *aggregates: Column) -> DataFrame:
    """Counts, minima and maxima of a whole Parquet table from its files' footers, as one row: no data page is read.

    Spark pushes such aggregates into its newer Parquet reader only, and only when told to; a session of its own has these
    settings, so the caller's stay as they are. Dates and numbers have their bounds in the footer, text has not.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(*aggregates)


def layer_path(root: str, layer: str, name: str) -> str:
    return f"{root}/{layer}/{name}"


def empty_like(df: DataFrame) -> DataFrame:
    """An empty table with the columns of ``df``; the optimizer drops the plan below the limit."""
    return df.limit(0)


def clustered(df: DataFrame, *columns: str) -> DataFrame:
    """Range-partition and sort, so that file statistics let readers skip.

    The range bounds are sampled over all the columns, so a hot leading value is spread over several files.
    """
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def skippable(writer: DataFrameWriter, keys: Sequence[str], distinct: int = 100_000) -> DataFrameWriter:
    """Have every row group written with a Bloom filter of each key, for up to about ``distinct`` values in it."""
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{key}", str(distinct)).option(f"parquet.bloom.filter.adaptive.enabled#{key}", "true")
    return writer


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, order: Sequence[str] = ()) -> DataFrame:
    """Write a layer bucketed by ``key`` as catalog table ``name`` and return it.

    One shuffle here saves all later ones by that key: aggregates, windows and joins whose keys
    include it find their rows in place. Each bucket is one file, sorted by ``order``.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key)
    if order:
        writer = writer.sortBy(*order)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def part_name(part: Column) -> Column:
    """A folder name for any value of a part: hex digits, so nothing needs escaping, and NULL has a name of its own."""
    return F.coalesce(F.concat(F.lit("x"), F.hex(part.cast("string"))), F.lit("null"))


def place_year(buckets: int, place: str = "location_id", day: str = "weather_date") -> Column:
    """Parts of a daily table: a bucket of places and a year. A year of new days touches one year's parts, all of a
    place's history one bucket's parts."""
    return F.concat_ws("-", F.pmod(F.xxhash64(place), F.lit(buckets)), F.year(day))


def register_bucketed(spark: SparkSession, name: str, path: str, key: str, buckets: int, order: Sequence[str] = ()) -> None:
    """Make a layer written by ``write_bucketed`` known to this session, with its buckets, without reading its rows."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    sort = f" SORTED BY ({', '.join(order)})" if order else ""
    spark.sql(f"CREATE TABLE `{name}` ({fields}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({key}){sort} INTO {buckets} BUCKETS")


def create_exclusively(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False where it exists. Of several callers exactly one gets True."""
    fs, target = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    if fs.getScheme() == "file":
        # The local file system of Hadoop looks first and creates then; Java's own does both at once.
        return spark._jvm.java.io.File(target.toUri().getPath()).createNewFile()
    return fs.createNewFile(target)


class VersionedTable:
    """A Parquet table whose versions replace whole parts and appear at once.

    A load writes the rows of some parts to a folder of its own, ``data/load=<id>/part_key=<part>``. A version is a table of
    (part, load) in ``versions/v=<n>``, next to one line of state: the last batch of every stream, and the highest values of
    ``tracked`` columns. Reading is a join of the data with that table on the two partition columns, by which
    Spark skips all other folders; parts are only ever handled as rows of tables.

    Version n + 1 is made from version n by the one writer that creates the file ``claims/v=<n + 1>``; all others are told so
    and merge again. The version is written aside and moved into place after that. A writer that dies between the two leaves a
    claim without a version, which nobody passes until ``release`` takes it away.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: Column | None = None,
                 tracked: Sequence[str] = ()):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.part = part_name(part if part is not None else F.lit("all"))
        self.tracked = tuple(tracked)
        others = [c for c in self.tracked if schema[c].dataType != T.StringType()]
        if others:
            raise ValueError(f"only text columns, such as time stamps in order of text, can be tracked: {others}")

    # -- reading

    def versions(self) -> list[int]:
        """All versions that are still kept."""
        return sorted(int(n[2:]) for n in child_names(self.spark, f"{self.path}/versions") if n.startswith("v="))

    def newest(self) -> int:
        """The number of the newest version, -1 before the first one."""
        return max(self.versions(), default=-1)

    def exists(self) -> bool:
        return self.newest() >= 0

    def parts(self, version: int) -> DataFrame:
        """part_key and load of every part of a version."""
        if version < 0:
            return self.spark.createDataFrame([], PARTS).limit(0)
        return self.spark.read.schema(PARTS).parquet(f"{self.path}/versions/v={version}/parts")

    def _state(self, version: int) -> dict[str, dict]:
        if version < 0:
            return {"batches": {}, "marks": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/v={version}/state").first()[0])

    def _rows(self, version: int, touched: DataFrame | None = None) -> DataFrame:
        """Rows of a version with their part, all or those of the parts in ``touched``."""
        if version < 0 or not path_exists(self.spark, f"{self.path}/data"):
            # The limit lets the optimizer see that there is nothing to merge with.
            return self.spark.createDataFrame([], self.schema).withColumn(PART, F.lit("")).limit(0)
        schema = T.StructType([*self.schema.fields, *PARTS.fields])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        # Spark prunes partitions by a join only if the other side is filtered; this filter keeps all.
        wanted = self.parts(version).where(F.col(PART) >= "")
        if touched is not None:
            wanted = wanted.join(touched, PART, "left_semi")
        return rows.join(wanted, [LOAD, PART], "left_semi").drop(LOAD)

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        return self._rows(self.newest()).drop(PART)

    def high_water(self, column: str) -> str | None:
        """The highest value of a tracked column, as text, from the version's state alone."""
        if column not in self.tracked:
            raise ValueError(f"{column} is not tracked")
        return self._state(self.newest())["marks"].get(column)

    # -- writing

    def _write(self, rows: DataFrame) -> str:
        """Write the rows of some parts as a new load.

        The rebalance hint lets adaptive execution split a large part over several files and put
        small ones into one.
        """
        load = uuid.uuid4().hex
        rows.hint("rebalance", PART).write.mode("errorifexists").partitionBy(PART).parquet(f"{self.path}/data/{LOAD}={load}")
        return load

    def _marks(self, rows: DataFrame) -> dict[str, str]:
        if not self.tracked:
            return {}
        highest = rows.agg(*[F.max(c).cast("string").alias(c) for c in self.tracked]).first()
        return {c: highest[c] for c in self.tracked if highest[c] is not None}

    def _commit(self, base: int, parts: DataFrame, state: dict[str, dict]) -> None:
        """Make ``parts`` the version after ``base``, if nobody else has made one."""
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        parts.select(*PARTS.fieldNames()).coalesce(1).write.parquet(f"{aside}/parts")
        self.spark.createDataFrame([(json.dumps(state),)], "state STRING").coalesce(1).write.text(f"{aside}/state")
        if not create_exclusively(self.spark, f"{self.path}/claims/v={base + 1}"):
            remove(self.spark, aside)
            raise ConcurrentWrite(f"version {base + 1} of {self.path} is another writer's; merge again, or release it if that one is gone")
        fs, source = _file_system(self.spark, aside)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/v={base + 1}")
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"version {base + 1} of {self.path} could not be moved into place")

    def release(self, version: int) -> None:
        """Take over from a writer that claimed a version and died. Only for claims whose writer is known to be gone."""
        if version in self.versions():
            raise ValueError(f"version {version} of {self.path} is complete")
        remove(self.spark, f"{self.path}/claims/v={version}")

    def overwrite(self, df: DataFrame) -> None:
        """Replace the whole table; its columns may be others than before."""
        base = self.newest()
        state = self._state(base)
        self.schema = df.schema
        load = self._write(df.withColumn(PART, self.part))
        written = self.spark.read.schema(T.StructType([*df.schema.fields, PARTS[PART]])).parquet(f"{self.path}/data/{LOAD}={load}")
        state["marks"] = self._marks(written)
        self._commit(base, written.select(PART).distinct().withColumn(LOAD, F.lit(load)), state)

    def upsert_latest(
        self, batch: DataFrame, keys: Sequence[str], sequence: Sequence[str], source: tuple[str, int] | None = None,
        distinct: bool = False,
    ) -> bool:
        """Merge a batch so that each key keeps its row with the highest sequence, old or new.

        ``source`` is a stream's id and batch number; a batch the table has already is skipped, and False returned. The
        batch is read once. ``distinct`` tells that it has one row per key, which an empty table takes as they are.
        """
        def latest(old: DataFrame | None, new: DataFrame) -> DataFrame:
            if old is None:
                return new if distinct else keep_latest(new, keys, sequence)
            return keep_latest(old.unionByName(new), keys, sequence)

        return self._merge(batch, source, latest)

    def upsert(self, batch: DataFrame, keys: Sequence[str], source: tuple[str, int] | None = None) -> bool:
        """Merge a batch whose rows replace those with the same key; others are added. Two rows of a key are an error."""
        def unique(old: DataFrame | None, new: DataFrame) -> DataFrame:
            twice = new.groupBy(*keys).count().where("count > 1").limit(3).collect()
            if twice:
                raise DuplicateKeys(f"more than one row for a key, such as {[tuple(r)[:-1] for r in twice]}")
            return new if old is None else replace_matching(old, new, keys)

        return self._merge(batch, source, unique)

    def _merge(self, batch: DataFrame, source: tuple[str, int] | None, combine) -> bool:
        base = self.newest()
        state = self._state(base)
        if source is not None:
            query, number = source
            if state["batches"].get(query, -1) >= number:
                return False
            state["batches"][query] = number
        # The batch is read several times: it is stored once, with the part of each row.
        aside = work_dir(self.spark, "batch")
        batch.select(*self.schema.fieldNames()).withColumn(PART, self.part).write.parquet(aside)
        new = self.spark.read.schema(T.StructType([*self.schema.fields, PARTS[PART]])).parquet(aside)
        touched = new.select(PART).distinct()
        fresh = self.parts(base).limit(0)
        if not new.isEmpty():
            names = self.schema.fieldNames()
            merged = combine(self._rows(base, touched).select(*names) if base >= 0 else None, new.select(*names))
            fresh = touched.withColumn(LOAD, F.lit(self._write(merged.withColumn(PART, self.part))))
            for column, high in self._marks(new).items():
                state["marks"][column] = max(high, state["marks"].get(column, high))
        self._commit(base, self.parts(base).join(touched, PART, "left_anti").unionByName(fresh), state)
        remove(self.spark, aside)
        return True

    def expire(self, keep: int) -> list[int]:
        """Remove all but the newest ``keep`` versions and the loads none of those names; the versions removed.

        Readers of an older version must be done. Loads of failed writers go too, so no writer may be at work.
        """
        if keep < 1:
            raise ValueError("at least the newest version stays")
        complete = self.versions()
        kept, gone = complete[-keep:], complete[:-keep]
        if not kept:
            return []
        # A load is one commit's; there are as many as commits.
        used = {r[0] for v in kept for r in self.parts(v).select(LOAD).distinct().collect()}
        for load in child_names(self.spark, f"{self.path}/data"):
            if load.startswith(f"{LOAD}=") and load[len(LOAD) + 1 :] not in used:
                remove(self.spark, f"{self.path}/data/{load}")
        for version in gone:
            remove(self.spark, f"{self.path}/versions/v={version}")
        remove(self.spark, f"{self.path}/aside")
        return gone


def newer_than_target(source: DataFrame, target: VersionedTable | DataFrame, sequence: str) -> DataFrame:
    """Source rows past the target's high-water mark; everything when the target is empty.

    The mark is read first and passed as a literal, so the filter reaches the source's files. A versioned
    table that tracks the column gives it without reading any row.
    """
    if isinstance(target, VersionedTable):
        mark = target.high_water(sequence)
        kind = source.schema[sequence].dataType
        return source if mark is None else source.where(F.col(sequence) > F.lit(mark).cast(kind))
    mark = target.agg(F.max(sequence)).first()[0]
    return source if mark is None else source.where(F.col(sequence) > F.lit(mark))
