"""The driver's tables seen as daily series.

A supplier is a place with a measuring station, and its shipments of one day are that day's
measurements, so series grow in number with the tables. Nations are places without a station.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.params import BacktestParams, BaselineParams, PlanningParams
from seriesloom.plans import climate, dims, features
from seriesloom.schemas import DIM_LOCATION, LOCATIONS, WEATHER_DAILY, conform

BASELINE = BaselineParams(first_year=1995, last_year=1998)
BACKTEST = BacktestParams(train_start_year=1995, test_years=(1999, 2000, 2001))
PLANNING = PlanningParams(history_start="1995-01-02")
TODAY = datetime.date(2001, 11, 10)
SCORED_AT = "2001-11-10 06:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _measures() -> list[Column]:
    return [
        F.max("l_quantity").alias("temperature_max_c"),
        F.min("l_quantity").alias("temperature_min_c"),
        F.avg("l_quantity").alias("temperature_mean_c"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).cast("double").alias("precipitation_mm"),
        F.max("l_tax").alias("wind_gust_max_kmh"),
    ]


def _shipments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("location_id"), F.col("l_shipdate").cast("date").alias("weather_date"),
        "l_quantity", "l_discount", "l_tax", "l_returnflag",
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """One row per place and day."""
    days = _shipments(spark, folder).groupBy("location_id", "weather_date").agg(*_measures())
    stamp = F.date_format(F.date_add("weather_date", 6), "yyyyMMdd'T053000Z'")
    return conform(days.withColumn("extracted_at", stamp), WEATHER_DAILY)


def weather_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three extraction runs per place and day: one per return flag, A before N before R."""
    days = _shipments(spark, folder).groupBy("location_id", "weather_date", "l_returnflag").agg(*_measures())
    run = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "2").otherwise("3")
    stamp = F.concat(F.lit("2002010"), run, F.lit("T053000Z"))
    return conform(days.withColumn("extracted_at", stamp), WEATHER_DAILY)


def locations(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    supplier = table(spark, folder, "supplier")
    country = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("country_code"),
    )
    stations = supplier.join(country, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("location_id"), F.col("s_name").alias("city"), "country_code", "country", "region",
        F.col("s_acctbal").alias("elevation_m"),
    )
    places = country.select(
        (-1 - F.col("n_nationkey")).cast("bigint").alias("location_id"), F.col("country").alias("city"),
        "country_code", "country", "region", F.lit(0.0).alias("elevation_m"),
    )
    everywhere = stations.unionByName(places).withColumns({
        "latitude": (F.pmod(F.col("location_id") * 37, F.lit(181)) - 90).cast("double"),
        "longitude": (F.pmod(F.col("location_id") * 73, F.lit(361)) - 180).cast("double"),
        "timezone": F.lit("UTC"),
        "population": F.when(F.col("elevation_m") >= 0, F.round(F.col("elevation_m") * 100).cast("bigint")),
        "_file_modified_at": F.lit(None).cast("timestamp"),
    })
    return conform(everywhere, LOCATIONS)


def dim_location(spark: SparkSession, folder: str) -> DataFrame:
    return conform(dims.dim_location(locations(spark, folder)), DIM_LOCATION)


def dim_date(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar of all whole years that the shipments touch."""
    ends = _shipments(spark, folder).agg(F.min("weather_date").alias("first"), F.max("weather_date").alias("last")).first()
    first, last = (ends[k] or TODAY for k in ("first", "last"))
    return dims.dim_date(dims.date_spine(spark, datetime.date(first.year, 1, 1), datetime.date(last.year, 12, 31)))


def fact(spark: SparkSession, folder: str) -> DataFrame:
    return climate.fact_daily(weather(spark, folder))


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    return climate.climate_baseline(fact(spark, folder), BASELINE)


def anomaly(spark: SparkSession, folder: str, split: bool = False) -> DataFrame:
    days = fact(spark, folder)
    return climate.climate_anomaly(days, climate.climate_baseline(days, BASELINE), split=split)


def feature_table(spark: SparkSession, folder: str, split: bool = False) -> DataFrame:
    return features.temperature_features(
        anomaly(spark, folder), fact(spark, folder), locations(spark, folder), split=split
    )
