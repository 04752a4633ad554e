"""Declared table schemas, checked at every layer boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "VARIANT": T.VariantType(),
}


def columns(text: str) -> T.StructType:
    """``name TYPE, ...`` as a schema; unlike Spark's own reader it needs no running session."""
    pairs = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


MEASURES = (
    "temperature_max_c",
    "temperature_min_c",
    "temperature_mean_c",
    "precipitation_mm",
    "wind_gust_max_kmh",
)

ENTITY_LIST = columns("city STRING, country_code STRING")

RAW = columns("raw VARIANT, _source_file STRING, _file_modified_at TIMESTAMP, _ingested_at TIMESTAMP")

WEATHER_DAILY = columns(
    "location_id BIGINT, weather_date DATE, temperature_max_c DOUBLE, temperature_min_c DOUBLE, "
    "temperature_mean_c DOUBLE, precipitation_mm DOUBLE, wind_gust_max_kmh DOUBLE, extracted_at STRING"
)

LOCATIONS = columns(
    "location_id BIGINT, city STRING, country_code STRING, country STRING, region STRING, latitude DOUBLE, "
    "longitude DOUBLE, elevation_m DOUBLE, timezone STRING, population BIGINT, _file_modified_at TIMESTAMP"
)

DIM_LOCATION = columns(
    "location_id BIGINT, city STRING, country_code STRING, country STRING, region STRING, latitude DOUBLE, "
    "longitude DOUBLE, elevation_m DOUBLE, timezone STRING, population BIGINT, hemisphere STRING, "
    "latitude_band STRING"
)

DIM_DATE = columns(
    "date_key INT, date_day DATE, year INT, quarter INT, month INT, month_name STRING, day_of_month INT, "
    "day_of_year INT, decade INT, season_code STRING"
)

FACT_DAILY = columns(
    "location_id BIGINT, date_key INT, weather_date DATE, temperature_max_c DOUBLE, temperature_min_c DOUBLE, "
    "temperature_mean_c DOUBLE, temperature_range_c DOUBLE, precipitation_mm DOUBLE, wind_gust_max_kmh DOUBLE, "
    "extracted_at STRING"
)

BASELINE = columns(
    "location_id BIGINT, day_of_year INT, baseline_mean_c DOUBLE, baseline_std_c DOUBLE, baseline_tmax_p90_c DOUBLE"
)

ANOMALY = columns(
    "location_id BIGINT, date_key INT, weather_date DATE, temperature_mean_c DOUBLE, temperature_max_c DOUBLE, "
    "baseline_mean_c DOUBLE, anomaly_c DOUBLE, anomaly_z DOUBLE, is_hot_day BOOLEAN, is_heatwave_day BOOLEAN, "
    "hot_run_length_days BIGINT"
)

FEATURES = columns(
    "location_id BIGINT, weather_date DATE, anomaly_lag0 DOUBLE, anomaly_lag1 DOUBLE, anomaly_lag2 DOUBLE, "
    "anomaly_lag3 DOUBLE, anomaly_lag7 DOUBLE, anomaly_mean_7d DOUBLE, anomaly_mean_30d DOUBLE, "
    "anomaly_std_7d DOUBLE, precipitation_sum_7d DOUBLE, wind_gust_max_kmh DOUBLE, temperature_range_c DOUBLE, "
    "doy_sin DOUBLE, doy_cos DOUBLE, latitude DOUBLE, elevation_m DOUBLE, target_h1 DOUBLE, target_h2 DOUBLE, "
    "target_h3 DOUBLE, target_h4 DOUBLE, target_h5 DOUBLE, target_h6 DOUBLE, target_h7 DOUBLE"
)

FORECAST = columns(
    "location_id BIGINT, date_key INT, target_date DATE, forecast_made_date DATE, horizon_days INT, "
    "anomaly_low_c DOUBLE, anomaly_mid_c DOUBLE, anomaly_high_c DOUBLE, baseline_mean_c DOUBLE, "
    "temperature_low_c DOUBLE, temperature_mid_c DOUBLE, temperature_high_c DOUBLE, model_name STRING, "
    "model_version INT, scored_at TIMESTAMP"
)

BACKTEST_METRICS = columns(
    "test_year INT, horizon INT, test_rows BIGINT, mae_model DOUBLE, mae_persistence DOUBLE, "
    "mae_climatology DOUBLE, mae_recent_normal DOUBLE, skill_vs_climatology DOUBLE, skill_vs_persistence DOUBLE, "
    "skill_vs_recent_normal DOUBLE, coverage_80 DOUBLE"
)

CITY_SUMMARY = columns(
    "location_id BIGINT, city STRING, country STRING, country_code STRING, latitude DOUBLE, longitude DOUBLE, "
    "elevation_m DOUBLE, timezone STRING, population BIGINT, hemisphere STRING, latitude_band STRING, "
    "first_date DATE, latest_date DATE, days_loaded BIGINT, anomaly_30d_c DOUBLE, anomaly_10y_c DOUBLE, "
    "heatwave_days_365d BIGINT, has_history BOOLEAN"
)

CITY_YEARLY = columns(
    "location_id BIGINT, year INT, days BIGINT, is_complete_year BOOLEAN, temperature_mean_c DOUBLE, "
    "anomaly_c DOUBLE, temperature_max_c DOUBLE, hot_days BIGINT, heatwave_days BIGINT, precipitation_mm DOUBLE"
)

CITY_RECENT_DAILY = columns(
    "location_id BIGINT, weather_date DATE, temperature_min_c DOUBLE, temperature_mean_c DOUBLE, "
    "temperature_max_c DOUBLE, baseline_mean_c DOUBLE, anomaly_c DOUBLE, is_hot_day BOOLEAN, "
    "is_heatwave_day BOOLEAN, precipitation_mm DOUBLE"
)

FORECAST_LATEST = columns(
    "location_id BIGINT, forecast_made_date DATE, target_date DATE, horizon_days INT, temperature_low_c DOUBLE, "
    "temperature_mid_c DOUBLE, temperature_high_c DOUBLE, anomaly_mid_c DOUBLE, model_version INT, "
    "scored_at TIMESTAMP"
)

MODEL_SKILL = columns(
    "horizon_days INT, mae_model_c DOUBLE, mae_recent_normal_c DOUBLE, mae_persistence_c DOUBLE, "
    "mae_climatology_c DOUBLE, skill_vs_recent_normal DOUBLE, coverage_80 DOUBLE, first_test_year INT, "
    "last_test_year INT, test_rows BIGINT"
)

SERVING = {
    "city_summary": CITY_SUMMARY,
    "city_yearly": CITY_YEARLY,
    "city_recent_daily": CITY_RECENT_DAILY,
    "forecast_latest": FORECAST_LATEST,
    "model_skill": MODEL_SKILL,
}


class SchemaMismatch(ValueError):
    """A table does not have the columns or types its layer declares."""


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Return ``df`` unchanged if its columns and types are the declared ones, in order."""
    found = [(f.name, f.dataType) for f in df.schema.fields]
    wanted = [(f.name, f.dataType) for f in schema.fields]
    if found != wanted:
        wrong = [f"{a} is not {b}" for a, b in zip(found, wanted, strict=False) if a != b]
        extra = found[len(wanted):] or wanted[len(found):]
        raise SchemaMismatch("; ".join(wrong) or f"unmatched columns {extra}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to the declared columns, in order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
