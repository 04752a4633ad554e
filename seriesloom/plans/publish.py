"""Export of the serving tables, and publishing after a check."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.plans.climate import ENTITY
from seriesloom.schemas import columns
from seriesloom.sources.tables import child_names, from_footers, path_exists, skippable

MANIFEST = columns(
    "exported_at TIMESTAMP, table_name STRING, row_count BIGINT, byte_count BIGINT, data_through DATE, fingerprint STRING"
)


class PublishRefused(RuntimeError):
    """The staged export does not match its manifest."""


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table, in one plan."""
    counts = [t.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(n)) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counts).select("table_name", "row_count")


def _staged_sizes(spark: SparkSession, staging: str, names: Iterable[str]) -> DataFrame:
    """Rows and bytes of the staged files. Row counts come from the file footers."""
    def one(name: str) -> DataFrame:
        files = spark.read.parquet(f"{staging}/{name}").select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
        )
        per_file = files.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
        return per_file.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("byte_count")
        ).withColumn("table_name", F.lit(name))

    return reduce(DataFrame.unionByName, [one(n) for n in names])


def fingerprint(df: DataFrame) -> Column:
    """An aggregate that tells tables with different rows apart, whatever their order: sums of two hashes over all columns.

    Sums of 64-bit hashes are added up exactly, so rows may be counted in any number of tasks, and a repeated row changes
    them like any other. Names and types of the columns are part of it.
    """
    described = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
    columns = [(F.col(f"`{name}`"), df.schema[name].dataType) for name in sorted(df.columns)]
    # A hash passes over NULL: flags tell missing columns, and nested values are hashed as text that names theirs.
    missing = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c, _ in columns])
    nested = (T.ArrayType, T.MapType, T.StructType)
    values = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if isinstance(kind, nested) else c for c, kind in columns]
    exact = "decimal(38, 0)"
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), missing, *values).cast(exact)), F.lit(0).cast(exact)) for seed in (1, 2)]
    return F.sha2(F.concat_ws("|", F.lit(described), F.count(F.lit(1)).cast("string"), *[x.cast("string") for x in sums]), 256)


def fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name and fingerprint of each table, in one plan."""
    found = [t.agg(fingerprint(t).alias("fingerprint")).select(F.lit(n).alias("table_name"), "fingerprint") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, found)


def newest_day(spark: SparkSession, path: str, column: str) -> datetime.date | None:
    """The latest date of a written table, from its footers; NULL where it has none."""
    try:
        return from_footers(spark, path, F.max(column)).first()[0]
    except (PySparkException, Py4JJavaError) as error:
        # Row groups without a value have no bounds to answer from.
        if "No min/max found" not in str(error):
            raise
        return spark.read.parquet(path).agg(F.max(column)).first()[0]


def manifest_rows(sizes: DataFrame, through: datetime.date | None, exported_at: datetime.datetime) -> DataFrame:
    """One row per table, all with the day that the data goes to."""
    absent = {c: F.lit(None).cast(MANIFEST[c].dataType) for c in ("byte_count", "fingerprint") if c not in sizes.columns}
    rows = sizes.withColumns(absent) if absent else sizes
    return rows.select(
        F.lit(exported_at).cast("timestamp").alias("exported_at"), "table_name",
        F.col("row_count").cast("bigint").alias("row_count"), F.col("byte_count").cast("bigint").alias("byte_count"),
        F.lit(through).cast("date").alias("data_through"), "fingerprint",
    )


def export_tables(
    spark: SparkSession, tables: Mapping[str, DataFrame], staging: str, exported_at: datetime.datetime,
    newest: tuple[str, str] = ("city_summary", "latest_date"),
) -> DataFrame:
    """Write each table to the staging folder and the manifest last; return the manifest.

    The rebalance hint makes one file of a small table and evenly sized files of a large one. Rows of
    one entity lie together and in order, so that a reader of one entity can skip the rest of a file, and every row group
    has a Bloom filter of its entities, so that a reader also skips those between whose first and last entity it lies.
    """
    for name, table in tables.items():
        if ENTITY in table.columns:
            table = table.hint("rebalance", ENTITY).sortWithinPartitions(ENTITY)
        else:
            table = table.hint("rebalance")
        skippable(table.write.mode("overwrite"), [ENTITY] if ENTITY in table.columns else []).parquet(f"{staging}/{name}")
    through = newest_day(spark, f"{staging}/{newest[0]}", newest[1])
    written = fingerprints({n: spark.read.parquet(f"{staging}/{n}") for n in tables})
    manifest = manifest_rows(_staged_sizes(spark, staging, tables).join(written, "table_name"), through, exported_at)
    manifest.coalesce(1).write.mode("overwrite").json(f"{staging}/manifest")
    return read_manifest(spark, staging)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    if not path_exists(spark, f"{folder}/manifest/_SUCCESS"):
        raise PublishRefused(f"there is no complete manifest in {folder}")
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def manifest_differences(manifest: DataFrame, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Every table that is missing, unexpected, or not as long as stated; empty when all is well."""
    stated = manifest.select("table_name", F.col("row_count").alias("stated_rows"))
    wanted = expected.select("table_name", F.lit(True).alias("is_expected"))
    found = observed.select("table_name", F.col("row_count").alias("found_rows"))
    joined = stated.join(wanted, "table_name", "full").join(found, "table_name", "full")
    problem = (
        F.when(F.col("is_expected").isNull(), "unexpected table")
        .when(F.col("stated_rows").isNull(), "not in the manifest")
        .when(F.col("found_rows").isNull(), "not staged")
        .when(F.col("found_rows") != F.col("stated_rows"), "wrong row count")
    )
    return joined.withColumn("problem", problem).where("problem is not null").select(
        "table_name", "problem", "stated_rows", "found_rows"
    )


def changed_tables(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Tables whose rows are not those the manifest was made from, though they may be as many."""
    stated = manifest.where("fingerprint is not null").select("table_name", F.col("fingerprint").alias("stated"))
    return stated.join(observed, "table_name").where("stated <> fingerprint").select(
        "table_name", F.lit("changed content").alias("problem"))


def publish(spark: SparkSession, staging: str, live: str, expected: Iterable[str]) -> str:
    """Check a staged export against its manifest and, if all of it holds, make it the live one.

    Nothing is moved: the live folder records which export is current, in one small commit.
    Returns the export's folder.
    """
    manifest = read_manifest(spark, staging)
    names = sorted(expected)
    staged = [n for n in names if path_exists(spark, f"{staging}/{n}")]
    wanted = spark.createDataFrame([(n,) for n in names], "table_name STRING")
    try:
        nothing = wanted.limit(0).withColumn("row_count", F.lit(0))
        observed = _staged_sizes(spark, staging, staged) if staged else nothing
        problems = manifest_differences(manifest, wanted, observed).collect()
        problems = problems or changed_tables(
            manifest, fingerprints({n: spark.read.parquet(f"{staging}/{n}") for n in staged})).collect()
    except (PySparkException, Py4JJavaError) as error:
        if not _is_unreadable(error):
            raise
        raise PublishRefused(f"a staged table cannot be read: {error}") from error
    if problems:
        raise PublishRefused("; ".join(sorted(f"{p.table_name}: {p.problem}" for p in problems)))
    # One past every pointer ever begun: one left behind by a crash must not block the next.
    version = max(_pointers(spark, live), default=-1) + 1
    pointer = spark.createDataFrame([(staging,)], "folder STRING").coalesce(1)
    pointer.write.mode("errorifexists").json(f"{live}/v={version}")
    return staging


# Error classes of files that are missing, damaged or not Parquet.
UNREADABLE = ("FAILED_READ_FILE", "CANNOT_READ_FILE", "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_MERGE_SCHEMA")


def _is_unreadable(error: Exception) -> bool:
    """Whether the data is at fault; a lost cluster or a programming error is not a refused export."""
    return any(name in str(error) for name in UNREADABLE)


def _pointers(spark: SparkSession, live: str) -> list[int]:
    return [int(n[2:]) for n in child_names(spark, live) if n.startswith("v=")]


def _live_versions(spark: SparkSession, live: str) -> list[int]:
    return [v for v in _pointers(spark, live) if path_exists(spark, f"{live}/v={v}/_SUCCESS")]


def live_folder(spark: SparkSession, live: str) -> str:
    """The folder of the published export."""
    versions = _live_versions(spark, live)
    if not versions:
        raise FileNotFoundError("nothing has been published yet")
    return spark.read.schema("folder STRING").json(f"{live}/v={max(versions)}").first()["folder"]


def live_table(spark: SparkSession, live: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{live_folder(spark, live)}/{name}")


def health(spark: SparkSession, live: str) -> DataFrame:
    """The published manifest with a status."""
    return read_manifest(spark, live_folder(spark, live)).withColumn("status", F.lit("ok"))
