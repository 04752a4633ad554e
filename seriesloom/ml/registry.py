"""Model versions, their alias, and the log of runs, as tables."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.ml.quantile_boost import QuantileForecaster
from seriesloom.schemas import columns
from seriesloom.sources.tables import path_exists

CHAMPION = "champion"
VERSIONS = columns("model_name STRING, version INT, path STRING, registered_at TIMESTAMP").add(
    "metrics", T.MapType(T.StringType(), T.DoubleType())
)
ALIASES = columns("model_name STRING, alias STRING, version INT, set_at TIMESTAMP")
RUN_LOG = columns(
    "run_name STRING, kind STRING, name STRING, text_value STRING, value DOUBLE, logged_at TIMESTAMP"
)


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC)


class Registry:
    """Append-only tables below one folder; the newest row decides.

    One writer at a time gives out version numbers, as one training job does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        folder = f"{self.path}/{name}"
        if not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def _append(self, name: str, rows: list[tuple], schema: T.StructType) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def versions(self, model_name: str) -> DataFrame:
        return self._table("versions", VERSIONS).where(F.col("model_name") == model_name)

    def run_log(self) -> DataFrame:
        return self._table("run_log", RUN_LOG)

    def register(
        self, model_name: str, model: QuantileForecaster, metrics: Mapping[str, float] | None = None
    ) -> int:
        """Store the model as a new version and point the champion alias at the highest one."""
        newest = self.versions(model_name).agg(F.max("version")).first()[0] or 0
        version = newest + 1
        path = f"{self.path}/models/{model_name}/{version}"
        model.save(self.spark, path)
        self._append("versions", [(model_name, version, path, _now(), dict(metrics or {}))], VERSIONS)
        self.set_alias(model_name, CHAMPION, version)
        return version

    def set_alias(self, model_name: str, alias: str, version: int) -> None:
        self._append("aliases", [(model_name, alias, version, _now())], ALIASES)

    def version_of(self, model_name: str, alias: str = CHAMPION) -> int:
        row = (
            self._table("aliases", ALIASES)
            .where((F.col("model_name") == model_name) & (F.col("alias") == alias))
            .agg(F.max_by("version", "set_at"))
            .first()
        )
        if row[0] is None:
            raise LookupError(f"{model_name} has no version called {alias}")
        return row[0]

    def load(self, model_name: str, alias: str = CHAMPION) -> tuple[QuantileForecaster, int]:
        version = self.version_of(model_name, alias)
        row = self.versions(model_name).where(F.col("version") == version).first()
        return QuantileForecaster.load(self.spark, row["path"]), version

    def log_run(
        self, run_name: str, params: Mapping[str, object] | None = None, metrics: Mapping[str, float] | None = None
    ) -> None:
        """Append the parameters and metrics of a run."""
        now = _now()
        rows = [(run_name, "param", k, str(v), None, now) for k, v in (params or {}).items()]
        rows += [(run_name, "metric", k, None, float(v), now) for k, v in (metrics or {}).items()]
        if rows:
            self._append("run_log", rows, RUN_LOG)
