"""Prepares a session for the text operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

from seriesloom.shipping import ship_package

BATCH, DEFAULT_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in the workers.

    Rows are whole documents, so batches of Spark's default number of rows would take tens of megabytes in the JVM and
    again in the worker; where that default is in force, smaller ones are set.
    """
    if spark.conf.get(BATCH, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH, ROWS)
    return ship_package(spark)
