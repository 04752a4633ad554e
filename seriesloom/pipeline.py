"""The daily refresh: landing files to published tables, one stored layer after the other.

Every step reads stored tables and writes stored tables, so a lost executor costs at most the tasks
it was running, and a failed step can be run again. A failing table test stops everything after it.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.ml import training
from seriesloom.ml.registry import Registry
from seriesloom.operators import quality
from seriesloom.params import BacktestParams, BaselineParams, BoostParams, RunParams, ServingParams
from seriesloom.plans import backtest, climate, dims, features, forecast, publish, serving
from seriesloom.sources import tables
from seriesloom.streaming import bronze, silver

FACT_KEY = ("location_id", "date_key")
DAY_ORDER = ("location_id", "weather_date")


@dataclass(frozen=True)
class PipelineParams:
    # Buckets of places per layer; size them so that one bucket fits in a task's memory.
    buckets: int
    model_name: str = "temperature"
    baseline: BaselineParams = BaselineParams()
    runs: RunParams = RunParams()
    backtest: BacktestParams = BacktestParams()
    boost: BoostParams = BoostParams()
    serving: ServingParams = field(default_factory=ServingParams)
    # Whether series are cut into blocks of a year in different tasks, for very long ones.
    split: bool = False
    # Files of one micro-batch, so that a backlog is taken in portions.
    files_per_batch: int = 2000
    # Complete versions that every keyed table keeps.
    keep_versions: int = 7


# The stored layers of the newest run that passed its tests.
LAYERS = schemas.columns("layer STRING, name STRING, run STRING, path STRING, buckets INT, order_by STRING")


class Pipeline:
    """All layers below one root folder.

    ``run`` names one refresh; bucketed layers of that run get their own folders and catalog names, so that earlier
    readers keep theirs. Which run is current is one commit, made after all table tests passed; a later session
    registers the layers anew from it. ``prefix`` keeps the catalog names of several pipelines apart.
    """

    def __init__(self, spark: SparkSession, root: str, run: str, params: PipelineParams, prefix: str = "loom"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.run = run
        self.prefix = prefix
        self.params = params
        self.registry = Registry(spark, f"{self.root}/ml/registry")

    # -- places

    def landing(self, name: str) -> str:
        return f"{self.root}/landing/{name}"

    def _checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"

    def _layer(self, layer: str, name: str) -> str:
        return tables.layer_path(self.root, layer, name)

    def _name(self, layer: str, name: str, run: str) -> str:
        return f"{self.prefix}_{layer}_{name}_{run}"

    def _store(self, df: DataFrame, layer: str, name: str, order: tuple[str, ...], stored: list[tuple]) -> DataFrame:
        """Write a layer of this run and note it in ``stored``; it is not current yet."""
        path = f"{self._layer(layer, name)}/run={self.run}"
        stored.append((layer, name, self.run, path, self.params.buckets, ",".join(order)))
        return tables.write_bucketed(
            df, self._name(layer, name, self.run), path, "location_id", self.params.buckets, order)

    @property
    def layers(self) -> tables.VersionedTable:
        return tables.VersionedTable(self.spark, f"{self.root}/layers", LAYERS)

    def table(self, layer: str, name: str) -> DataFrame:
        """A bucketed layer of the current run; registered with its buckets if this session does not know it."""
        found = self.layers.read().where((F.col("layer") == layer) & (F.col("name") == name)).first()
        if found is None:
            raise LookupError(f"{layer}.{name} has not been built below {self.root}")
        known = self._name(layer, name, found["run"])
        if not self.spark.catalog.tableExists(known):
            tables.register_bucketed(
                self.spark, known, found["path"], "location_id", found["buckets"], [c for c in found["order_by"].split(",") if c])
        return self.spark.table(known)

    @property
    def weather(self) -> tables.VersionedTable:
        return silver.weather_table(self.spark, self._layer("silver", "weather_daily"), self.params.buckets)

    @property
    def locations(self) -> tables.VersionedTable:
        return silver.location_table(self.spark, self._layer("silver", "locations"), self.params.buckets)

    @property
    def fact(self) -> tables.VersionedTable:
        return tables.VersionedTable(
            self.spark, self._layer("gold", "fact_weather_daily"), schemas.FACT_DAILY,
            tables.place_year(self.params.buckets), ("extracted_at",))

    @property
    def forecasts(self) -> tables.VersionedTable:
        return forecast.forecast_table(self.spark, self._layer("gold", "fact_forecast"))

    @property
    def metrics(self) -> tables.VersionedTable:
        return tables.VersionedTable(self.spark, self._layer("ml", "backtest_metrics"), schemas.BACKTEST_METRICS)

    # -- steps

    @property
    def expectations(self) -> str:
        """Where the counts of rows dropped, warned about or absent are kept, per stream and batch."""
        return self._layer("silver", "expectations")

    def refresh_silver(self) -> None:
        """New landing files to raw rows, and raw rows to the latest row per key, with all expectations counted."""
        refreshes = {"locations": silver.refresh_locations, "weather_daily": silver.refresh_weather}
        for name, refresh in refreshes.items():
            raw = self._layer("bronze", f"{name}_raw")
            bronze.load_raw(
                self.spark, self.landing(name), raw, self._checkpoint(f"bronze_{name}"), self.params.files_per_batch
            ).awaitTermination()
            refresh(
                self.spark, raw, self._layer("silver", name), self._checkpoint(f"silver_{name}"), self.params.buckets,
                silver.metrics_sink(self.spark, self.expectations, name), self.params.files_per_batch,
            ).awaitTermination()
        for table in (self.weather, self.locations):
            table.expire(self.params.keep_versions)

    def build_gold(self, today: datetime.date) -> None:
        """Dimensions, facts, normals and deviations. Each layer is tested before the next one reads it.

        Facts are loaded from what is newer than the fact table's mark. They are bucketed by place once;
        everything above them then needs no shuffle. The layers become current together, at the end.
        """
        stored: list[tuple] = []
        target, not_null, unique = self.fact, quality.not_null, quality.unique
        new = tables.newer_than_target(self.weather.read().drop(silver.SOURCE), target, "extracted_at")
        target.upsert_latest(climate.fact_daily(new), FACT_KEY, ("extracted_at",))
        target.expire(self.params.keep_versions)
        places = self._store(dims.dim_location(self.locations.read()), "gold", "dim_location", ("location_id",), stored)
        calendar = dims.dim_date(dims.default_spine(self.spark, today))
        quality.require(quality.report([
            not_null("dim_location", places, ["location_id"]), unique("dim_location", places, ["location_id"]),
            not_null("dim_date", calendar, ["date_key"]), unique("dim_date", calendar, ["date_key"]),
        ]))
        facts = self._store(target.read(), "gold", "fact_daily", DAY_ORDER, stored)
        quality.require(quality.report([
            not_null("fact_weather_daily", facts, FACT_KEY), unique("fact_weather_daily", facts, FACT_KEY),
            quality.relationship("fact_weather_daily", facts, "location_id", places),
            quality.relationship("fact_weather_daily", facts, "date_key", calendar),
        ]))
        base = self._store(
            climate.climate_baseline(facts, self.params.baseline), "gold", "climate_baseline",
            ("location_id", "day_of_year"), stored)
        quality.require(quality.report([not_null("climate_baseline", base, ["location_id", "baseline_mean_c"])]))
        days = self._store(
            climate.climate_anomaly(facts, base, self.params.runs, self.params.split), "gold", "fact_climate_anomaly",
            DAY_ORDER, stored)
        quality.require(quality.report([
            not_null("fact_climate_anomaly", days, ["location_id", "date_key", "anomaly_c"])]))
        table = self._store(
            features.temperature_features(days, facts, places, self.params.split), "ml", "features_temperature",
            DAY_ORDER, stored)
        quality.require(quality.report([
            not_null("features_temperature", table, ["location_id", "weather_date", "anomaly_lag0"])]))
        self.layers.overwrite(self.spark.createDataFrame(stored, LAYERS))

    def backtest(self) -> None:
        """Measure the forecaster on past years and replace the metrics table."""
        table = self.table("ml", "features_temperature")
        self.metrics.overwrite(training.backtest(table, self.params.backtest, self.params.boost, self.registry))

    def train(self) -> int:
        """Fit on all rows and make the result the champion."""
        table = self.table("ml", "features_temperature")
        start = self.params.backtest.train_start_year
        return training.train(table, self.registry, self.params.model_name, start, self.params.boost)

    def score(self) -> None:
        """Forecast from the newest day of every place and keep the forecasts."""
        scored = training.score_champion(
            self.table("ml", "features_temperature"), self.table("gold", "climate_baseline"), self.registry,
            self.params.model_name,
        )
        forecast.store_forecast(self.forecasts, scored)

    def serving_tables(self) -> dict[str, DataFrame]:
        days, facts = self.table("gold", "fact_climate_anomaly"), self.table("gold", "fact_daily")
        places, params = self.table("gold", "dim_location"), self.params.serving
        return {
            "city_summary": serving.city_summary(places, days, params),
            "city_yearly": serving.city_yearly(days, facts, params),
            "city_recent_daily": serving.city_recent_daily(days, facts, params),
            "forecast_latest": serving.forecast_latest(self.forecasts.read()),
            "model_skill": backtest.model_skill(self.metrics.read()),
        }

    def publish(self, exported_at: datetime.datetime) -> str:
        """Export the serving tables, test what was written, and publish it if all holds."""
        staging = f"{self._layer('serving', 'exports')}/run={self.run}"
        publish.export_tables(self.spark, self.serving_tables(), staging, exported_at)
        written = {n: self.spark.read.parquet(f"{staging}/{n}") for n in self.params.serving.tables}
        quality.require(quality.report([
            quality.not_null("city_summary", written["city_summary"], ["location_id"]),
            quality.unique("city_summary", written["city_summary"], ["location_id"]),
            quality.not_null("city_yearly", written["city_yearly"], ["location_id", "year"]),
            quality.not_null("city_recent_daily", written["city_recent_daily"], ["weather_date"]),
            quality.not_null("forecast_latest", written["forecast_latest"], ["temperature_mid_c"]),
            quality.not_null("model_skill", written["model_skill"], ["horizon_days"]),
            quality.unique("model_skill", written["model_skill"], ["horizon_days"]),
        ]))
        return publish.publish(self.spark, staging, self.live, self.params.serving.tables)

    @property
    def live(self) -> str:
        return self._layer("serving", "live")

    def refresh(self, today: datetime.date, exported_at: datetime.datetime) -> str:
        """One daily run. The champion and its backtest must exist."""
        self.refresh_silver()
        self.build_gold(today)
        self.score()
        return self.publish(exported_at)
