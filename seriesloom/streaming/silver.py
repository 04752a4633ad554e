"""Raw tables to one clean row per key, latest value wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seriesloom import schemas
from seriesloom.operators.latest import keep_latest
from seriesloom.operators.nested import explode_parallel, variant_fields
from seriesloom.operators.quality import drop_violations, violation_counts
from seriesloom.sources.tables import VersionedTable, place_year

# Where each field sits in a daily reply.
REPLY_FIELDS = {
    "location_id": ("$.location_id", "bigint"),
    "extracted_at": ("$.extracted_at", "string"),
    "date_str": ("$.payload.daily.time", "array<string>"),
    "temperature_max_c": ("$.payload.daily.temperature_2m_max", "array<double>"),
    "temperature_min_c": ("$.payload.daily.temperature_2m_min", "array<double>"),
    "temperature_mean_c": ("$.payload.daily.temperature_2m_mean", "array<double>"),
    "precipitation_mm": ("$.payload.daily.precipitation_sum", "array<double>"),
    "wind_gust_max_kmh": ("$.payload.daily.wind_gusts_10m_max", "array<double>"),
}

# Where each field sits in a location reply.
LOCATION_FIELDS = {
    "location_id": ("$.id", "bigint"),
    "city": ("$.name", "string"),
    "country_code": ("$.country_code", "string"),
    "country": ("$.country", "string"),
    "region": ("$.admin1", "string"),
    "latitude": ("$.latitude", "double"),
    "longitude": ("$.longitude", "double"),
    "elevation_m": ("$.elevation", "double"),
    "timezone": ("$.timezone", "string"),
    "population": ("$.population", "bigint"),
}

def present(*names: str) -> str:
    return " and ".join(f"{n} is not null" for n in names)


def within(name: str, low: float, high: float) -> str:
    return f"({name} >= {low} and {name} <= {high})"


def unless_missing(rule: str, *names: str) -> str:
    """A rule that a missing value does not break."""
    return " or ".join([*(f"{n} is null" for n in names), rule])


# The limits of the expectations.
LATITUDE, LONGITUDE, PLAUSIBLE_MAX_C, LEAST_RAIN = (-90, 90), (-180, 180), (-90, 60), 0

# Rows failing these are dropped.
WEATHER_REQUIRED = {
    "valid_key": present("location_id", "weather_date"),
    "complete_day": present("temperature_mean_c"),
}
LOCATION_REQUIRED = {
    "valid_location": " and ".join(
        [present("location_id"), within("latitude", *LATITUDE), within("longitude", *LONGITUDE)]),
}
# Rows failing these are kept and counted.
WEATHER_EXPECTED = {
    "plausible_temperature": unless_missing(within("temperature_max_c", *PLAUSIBLE_MAX_C), "temperature_max_c"),
    "min_not_above_max": unless_missing(
        "temperature_max_c >= temperature_min_c", "temperature_min_c", "temperature_max_c"),
    "non_negative_precipitation": unless_missing(f"precipitation_mm >= {LEAST_RAIN}", "precipitation_mm"),
}

SOURCE = "_source_file"
ARRAYS = ("date_str", *schemas.MEASURES)


def reply_arrays(raw: DataFrame, tolerant: bool = False) -> DataFrame:
    """The key, the sequence and the parallel arrays of each daily reply."""
    keep = [SOURCE] if SOURCE in raw.columns else []
    return raw.select(*variant_fields(REPLY_FIELDS, tolerant=tolerant), *keep)


def weather_rows(
    raw: DataFrame, tolerant: bool = False, fill_missing: bool = False, replies: Observation | None = None
) -> DataFrame:
    """One row per entity and day of each daily reply. ``replies`` counts the replies as they pass by."""
    keep = ["location_id", "extracted_at", *([SOURCE] if SOURCE in raw.columns else [])]
    arrays = reply_arrays(raw, tolerant)
    if replies is not None:
        arrays = arrays.observe(replies, *reply_counts())
    rows = explode_parallel(arrays, ARRAYS, keep, fill_missing)
    day = F.try_to_date("date_str", "yyyy-MM-dd") if tolerant else F.to_date("date_str", "yyyy-MM-dd")
    return rows.select(
        "location_id",
        day.alias("weather_date"),
        *schemas.MEASURES,
        *[c for c in keep if c != "location_id"],
    )


def location_rows(raw: DataFrame, tolerant: bool = False) -> DataFrame:
    """Typed columns of each location reply."""
    keep = [c for c in ("_file_modified_at", SOURCE) if c in raw.columns]
    return raw.select(*variant_fields(LOCATION_FIELDS, tolerant=tolerant), *keep)


def reply_counts() -> list[Column]:
    """How many replies there are, and how many give no rows because a measure is absent; for an aggregate or an observation
    of the arrays, so that no reply is unpacked twice."""
    absent = [F.col(name).isNull() for name in ARRAYS]
    return [F.count(F.lit(1)).alias("replies"), F.count_if(reduce(or_, absent)).alias("replies_without_rows")]


def reply_metrics(raw: DataFrame) -> DataFrame:
    """The counts of replies, as one row."""
    return reply_arrays(raw).agg(*reply_counts())


def with_source(schema: T.StructType) -> T.StructType:
    """The target also holds the source file, which decides between equal sequences."""
    return T.StructType([*schema.fields, T.StructField(SOURCE, T.StringType())])


def weather_table(spark: SparkSession, path: str, buckets: int = 16) -> VersionedTable:
    """The daily table, in parts of a bucket of places and a year: new days rewrite one year's parts, a place's
    whole history one bucket's. It tracks the newest extraction, which later loads start from."""
    return VersionedTable(spark, path, with_source(schemas.WEATHER_DAILY), place_year(buckets), ("extracted_at",))


def location_table(spark: SparkSession, path: str, buckets: int = 16) -> VersionedTable:
    return VersionedTable(
        spark, path, with_source(schemas.LOCATIONS), F.pmod(F.xxhash64("location_id"), F.lit(buckets))
    )


METRICS = schemas.columns("table_name STRING, query STRING, batch BIGINT, metric STRING, amount BIGINT")
OnMetrics = Callable[[str, int, dict[str, int]], None]


def metrics_sink(spark: SparkSession, path: str, table: str) -> OnMetrics:
    """Keeps the counts of every batch below ``path``; a batch that is run again replaces its own."""
    def keep(query: str, batch: int, counts: dict[str, int]) -> None:
        rows = [(table, query, batch, name, int(amount)) for name, amount in sorted(counts.items())]
        frame = spark.createDataFrame(rows, METRICS).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{path}/{table}-{query}-{batch}")

    return keep


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All counts kept below ``path``: table_name, query, batch, metric, amount."""
    return spark.read.schema(METRICS).option("recursiveFileLookup", "true").parquet(path)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps as long as its checkpoint."""
    return spark.read.schema("id STRING").json(f"{checkpoint}/metadata").first()["id"]


def upsert_stream(
    raw: DataFrame,
    prepare: Callable[[DataFrame, Observation | None], DataFrame],
    target: VersionedTable,
    keys: Sequence[str],
    sequence: Sequence[str],
    required: dict[str, str],
    expected: dict[str, str],
    checkpoint: str,
    on_metrics: OnMetrics | None = None,
    measure: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Merge a stream of raw rows into a keyed table: drop bad rows first, then the highest sequence wins.

    Because dropping comes first, a newer but incomplete row never replaces an older complete one. The table
    records the stream's id and batch number, so a batch that is run again is skipped. Counts of raw rows that ``measure``
    gives as one row, ``prepare`` adds to the observation it is handed.
    """
    spark = raw.sparkSession

    dropped = [c.alias(f"dropped_{n}") for n, c in zip(required, violation_counts(required), strict=True)]
    wanted = [F.count(F.lit(1)).alias("row_count"), *dropped, *violation_counts(expected)]

    def merge(batch: DataFrame, batch_id: int) -> None:
        query = query_id(spark, checkpoint)
        # Everything is counted while the merge stores the batch, which it does once.
        replies, rows = Observation(f"replies-{batch_id}"), Observation(f"rows-{batch_id}")
        prepared = prepare(batch, replies if on_metrics and measure else None)
        prepared = prepared.observe(rows, *wanted) if on_metrics else prepared
        newest = keep_latest(drop_violations(prepared, required), keys, sequence)
        merged = target.upsert_latest(newest, keys, sequence, source=(query, batch_id), distinct=True)
        if not on_metrics:
            return
        if merged:
            counts = rows.get | (replies.get if measure else {})
        else:
            # The table had the batch already, so nothing was written; its counts may not have been kept.
            counts = prepare(batch, None).agg(*wanted).first().asDict()
            counts |= measure(batch).first().asDict() if measure else {}
        on_metrics(query, batch_id, counts)

    return (
        raw.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def raw_stream(spark: SparkSession, raw_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The raw table as a stream of its own new rows."""
    reader = spark.readStream.schema(schemas.RAW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(raw_path)


def refresh_weather(
    spark: SparkSession,
    raw_path: str,
    path: str,
    checkpoint: str,
    buckets: int = 16,
    on_metrics: OnMetrics | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    return upsert_stream(
        raw_stream(spark, raw_path, max_files_per_trigger),
        lambda batch, replies: weather_rows(batch, False, False, replies), weather_table(spark, path, buckets),
        ("location_id", "weather_date"), ("extracted_at", SOURCE), WEATHER_REQUIRED, WEATHER_EXPECTED, checkpoint,
        on_metrics, reply_metrics,
    )


def refresh_locations(
    spark: SparkSession,
    raw_path: str,
    path: str,
    checkpoint: str,
    buckets: int = 16,
    on_metrics: OnMetrics | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    return upsert_stream(
        raw_stream(spark, raw_path, max_files_per_trigger),
        lambda batch, replies: location_rows(batch), location_table(spark, path, buckets),
        ("location_id",), ("_file_modified_at", SOURCE), LOCATION_REQUIRED, {}, checkpoint, on_metrics,
    )
