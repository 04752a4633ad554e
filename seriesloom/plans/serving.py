"""Small tables for readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.numeric import round_half_up
from seriesloom.operators.series import within_days
from seriesloom.params import ServingParams
from seriesloom.plans.climate import DAY, ENTITY
from seriesloom.schemas import (
    CITY_RECENT_DAILY,
    CITY_SUMMARY,
    CITY_YEARLY,
    FORECAST_LATEST,
    conform,
)


def with_latest(anomaly: DataFrame) -> DataFrame:
    """Each row with the latest day of its entity.

    A join with an aggregate instead of a window, which would hold all rows of an entity for one date. Rows that are already
    partitioned by entity stay where they are, and the aggregate reads two columns.
    """
    latest = anomaly.groupBy(ENTITY).agg(F.max(DAY).alias("latest_date"))
    return anomaly.join(latest, ENTITY).select(*anomaly.columns, "latest_date")


def series_history(anomaly: DataFrame, params: ServingParams = ServingParams()) -> DataFrame:
    """Bounds of each entity's series, and figures over the days that end at its own latest day."""
    def recent(days: int) -> Column:
        return within_days(F.col(DAY), F.col("latest_date"), days)

    return with_latest(anomaly.select(ENTITY, DAY, "anomaly_c", "is_heatwave_day")).groupBy(ENTITY).agg(
        F.min(DAY).alias("first_date"),
        F.max("latest_date").alias("latest_date"),
        F.count(F.lit(1)).alias("days_loaded"),
        F.avg(F.when(recent(params.short_days), F.col("anomaly_c"))).alias("anomaly_30d_c"),
        F.avg(F.when(recent(params.long_days), F.col("anomaly_c"))).alias("anomaly_10y_c"),
        F.count_if(recent(params.wave_days) & F.col("is_heatwave_day")).alias("heatwave_days_365d"),
    )


def city_summary(locations: DataFrame, anomaly: DataFrame, params: ServingParams = ServingParams()) -> DataFrame:
    """One row per entity, also for those that have no history yet."""
    return conform(
        locations.join(series_history(anomaly, params), ENTITY, "left").withColumns({
            "anomaly_30d_c": round_half_up(F.col("anomaly_30d_c"), 2),
            "anomaly_10y_c": round_half_up(F.col("anomaly_10y_c"), 2),
            "has_history": F.col("latest_date").isNotNull(),
        }),
        CITY_SUMMARY,
    )


def with_measures(anomaly: DataFrame, fact: DataFrame, *measures: str) -> DataFrame:
    """Deviations next to more of the day's measurements."""
    return anomaly.join(fact.select(ENTITY, DAY, *measures), [ENTITY, DAY])


def city_yearly(anomaly: DataFrame, fact: DataFrame, params: ServingParams = ServingParams()) -> DataFrame:
    """Yearly figures per entity."""
    days = F.count(F.lit(1))
    return conform(
        with_measures(anomaly, fact, "precipitation_mm")
        .groupBy(ENTITY, F.year(DAY).alias("year"))
        .agg(
            days.alias("days"),
            (days >= params.complete_year_days).alias("is_complete_year"),
            round_half_up(F.avg("temperature_mean_c"), 2).alias("temperature_mean_c"),
            round_half_up(F.avg("anomaly_c"), 2).alias("anomaly_c"),
            round_half_up(F.max("temperature_max_c"), 1).alias("temperature_max_c"),
            F.count_if("is_hot_day").alias("hot_days"),
            F.count_if("is_heatwave_day").alias("heatwave_days"),
            round_half_up(F.sum("precipitation_mm"), 1).alias("precipitation_mm"),
        ),
        CITY_YEARLY,
    )


def city_recent_daily(anomaly: DataFrame, fact: DataFrame, params: ServingParams = ServingParams()) -> DataFrame:
    """The latest days of each entity.

    The rows are cut to those days before the measurements are joined to them.
    """
    recent = with_latest(anomaly).where(within_days(F.col(DAY), F.col("latest_date"), params.recent_days))
    rows = with_measures(recent, fact, "temperature_min_c", "precipitation_mm")
    return conform(rows.withColumn("baseline_mean_c", round_half_up(F.col("baseline_mean_c"), 2)), CITY_RECENT_DAILY)


def forecast_latest(forecasts: DataFrame) -> DataFrame:
    """All horizons of each entity's newest forecast."""
    newest = forecasts.groupBy(ENTITY).agg(F.max("forecast_made_date").alias("forecast_made_date"))
    digits = {"temperature_low_c": 1, "temperature_mid_c": 1, "temperature_high_c": 1, "anomaly_mid_c": 2}
    return conform(
        forecasts.join(newest, [ENTITY, "forecast_made_date"]).withColumns(
            {name: round_half_up(F.col(name), n) for name, n in digits.items()}
        ),
        FORECAST_LATEST,
    )
