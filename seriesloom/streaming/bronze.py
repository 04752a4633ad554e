"""Landing files to raw tables, as they are."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from seriesloom.sources.landing import stream_landing


def load_raw(
    spark: SparkSession, landing: str, target: str, checkpoint: str, max_files_per_trigger: int | None = None
) -> StreamingQuery:
    """Append every file not seen before to the raw table, then stop."""
    return (
        stream_landing(spark, landing, max_files_per_trigger)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
