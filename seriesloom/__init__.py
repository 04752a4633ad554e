"""Daily measurement series on Spark: ingest, model, forecast, serve."""

__version__ = "0.1.0"
