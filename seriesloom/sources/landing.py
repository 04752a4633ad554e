"""Landing folders: JSON replies, snapshots and the entity list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom import schemas
from seriesloom.functions.calendar import stamp
from seriesloom.sources.tables import child_names

SNAPSHOT = "snapshot"


def with_load_metadata(df: DataFrame) -> DataFrame:
    """The raw value with where it came from and when it was loaded."""
    return df.select(
        F.col("raw"),
        F.col("_metadata.file_path").alias("_source_file"),
        F.col("_metadata.file_modification_time").alias("_file_modified_at"),
        F.current_timestamp().alias("_ingested_at"),
    )


def _json_variant(reader, folder: str) -> DataFrame:
    return reader.format("json").option("singleVariantColumn", "raw").option("recursiveFileLookup", "true").load(folder)


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a landing folder as one VARIANT column plus load metadata."""
    return with_load_metadata(_json_variant(spark.read, folder))


def stream_landing(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a landing folder as a stream; each file is taken exactly once per checkpoint."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return with_load_metadata(_json_variant(reader, folder))


def read_entity_list(spark: SparkSession, path: str, schema: T.StructType = schemas.ENTITY_LIST) -> DataFrame:
    """The CSV list of requested entities, with a header line."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")


def envelope(
    entity: Column, start: Column, end: Column, extracted_at: Column, payload: Column
) -> list[Column]:
    """One reply wrapped with what was asked for and when."""
    return [
        entity.cast("bigint").alias("location_id"),
        F.date_format(start, "yyyy-MM-dd").alias("requested_start"),
        F.date_format(end, "yyyy-MM-dd").alias("requested_end"),
        extracted_at.alias("extracted_at"),
        payload.alias("payload"),
    ]


def land(records: DataFrame, folder: str) -> None:
    """Append records to a landing folder as JSON lines; absent fields stay absent."""
    records.write.mode("append").json(folder)


def land_snapshot(records: DataFrame, folder: str, run_stamp: str) -> None:
    """Write one complete snapshot below ``folder``, under the stamp of its run."""
    records.write.mode("errorifexists").json(f"{folder}/{SNAPSHOT}={run_stamp}")


def newest_snapshot(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The records of the snapshot whose name sorts last. Only folder names are looked at to find it."""
    prefix = f"{SNAPSHOT}="
    names = [n for n in child_names(spark, folder) if n.startswith(prefix)]
    if not names:
        raise FileNotFoundError(f"no snapshot below {folder}")
    return spark.read.schema(schema).json(f"{folder}/{max(names)}")


def run_stamp() -> Column:
    """The current time as a run stamp."""
    return stamp(F.current_timestamp())
