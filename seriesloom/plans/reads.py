"""Read queries over the serving tables, and the figures a dashboard derives from them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numeric import clamp_scale, nan_to_null
from seriesloom.functions.wording import describe_anomaly, describe_vs_average
from seriesloom.operators.series import full_moving_mean, last_rows
from seriesloom.plans.climate import DAY, ENTITY

# Full colour is reached at these deviations.
DAY_LIMIT = 4.0
YEAR_LIMIT = 2.5
# Fixed values of the long view.
NEEDED_YEARS = 20
RECENT_YEARS = 10
WARMEST = 10
SINCE_YEAR = 2010


class NoRows(LookupError):
    """The entity has no rows in this table."""


# -- plain reads


def clean(rows: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column."""
    floats = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")}
    return rows.select(*[nan_to_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in rows.columns])


def read_all(table: DataFrame, order: str) -> DataFrame:
    return clean(table).orderBy(order)


def read_entity(table: DataFrame, location_id: int, order: str) -> DataFrame:
    """One entity's rows in order; the filter reaches the files."""
    return clean(table.where(F.col(ENTITY) == location_id)).orderBy(order)


def require_rows(rows: DataFrame) -> DataFrame:
    """Return the rows, or raise when there are none."""
    if rows.isEmpty():
        raise NoRows("no rows for this entity")
    return rows


# -- figures over the summary


def ready(summary: DataFrame) -> DataFrame:
    return summary.where("has_history")


def standouts(summary: DataFrame, count: int = 3) -> DataFrame:
    """The entities furthest from their normal right now, with the difference in words and on a scale."""
    known = ready(summary).where(F.col("anomaly_30d_c").isNotNull())
    furthest = known.orderBy(F.abs("anomaly_30d_c").desc(), "city", ENTITY).limit(count)
    return furthest.select(
        ENTITY, "city", "anomaly_30d_c",
        describe_anomaly(F.col("anomaly_30d_c")).alias("in_words"),
        clamp_scale(F.col("anomaly_30d_c"), DAY_LIMIT).alias("scale"),
    )


def default_entity(summary: DataFrame) -> DataFrame:
    """The entity to open on: furthest from normal, or the first ready one when none is known."""
    distance = F.abs("anomaly_30d_c")
    return ready(summary).orderBy(distance.desc_nulls_last(), "city", ENTITY).limit(1).select(ENTITY, "city")


def entity_menu(summary: DataFrame) -> DataFrame:
    """Ready entities by name, then those still waiting, by name."""
    return summary.select(ENTITY, "city", "has_history").orderBy(F.col("has_history").desc(), "city", ENTITY)


def load_progress(summary: DataFrame, history_start: datetime.date) -> DataFrame:
    """How many entities are loaded, through which day, and about how many records that makes."""
    counted = summary.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_history").alias("ready"),
        F.max("latest_date").alias("data_through"),
    )
    days = F.datediff("data_through", F.lit(history_start)) + 1
    return counted.withColumn("records", F.floor(F.col("ready") * days / 1000 + 0.5) * 1000)


# -- figures over the yearly table: a window holds one row per year of an entity


def complete_years(yearly: DataFrame) -> DataFrame:
    return yearly.where("is_complete_year")


def year_scale(yearly: DataFrame) -> DataFrame:
    """Each complete year's deviation on the tighter yearly scale, and in words."""
    value = F.col("anomaly_c")
    return complete_years(yearly).select(
        ENTITY, "year", "anomaly_c",
        clamp_scale(value, YEAR_LIMIT).alias("scale"),
        describe_vs_average(value).alias("in_words"),
    )


def moving_average(yearly: DataFrame, rows: int = RECENT_YEARS) -> DataFrame:
    """Mean over ten complete years, from the tenth on."""
    by_year = Window.partitionBy(ENTITY).orderBy("year")
    return complete_years(yearly).select(ENTITY, "year", "anomaly_c", full_moving_mean("anomaly_c", by_year, rows).alias("moving_mean"))


def warmest_years(yearly: DataFrame, count: int = WARMEST) -> DataFrame:
    """The warmest complete years of each entity; the earlier year comes first on a tie."""
    warm_first = Window.partitionBy(ENTITY).orderBy(F.col("anomaly_c").desc(), "year")
    ranked = complete_years(yearly).select(ENTITY, "year", "anomaly_c", F.row_number().over(warm_first).alias("warm_rank"))
    return ranked.where(F.col("warm_rank") <= count)


def long_view(
    yearly: DataFrame, needed: int = NEEDED_YEARS, recent: int = RECENT_YEARS, warmest: int = WARMEST,
    since: int = SINCE_YEAR,
) -> DataFrame:
    """Per entity with enough full years: the mean of the last ones, and how many records are recent."""
    whole = Window.partitionBy(ENTITY)
    rows = complete_years(yearly).select(
        ENTITY, "year", "anomaly_c",
        F.count(F.lit(1)).over(whole).alias("_years"),
        F.row_number().over(whole.orderBy(F.col("year").desc())).alias("_newest"),
        F.row_number().over(whole.orderBy(F.col("anomaly_c").desc(), "year")).alias("_warmest"),
    )
    last = F.col("_newest") <= recent
    return (
        rows.where(F.col("_years") >= needed)
        .groupBy(ENTITY)
        .agg(
            F.min("year").alias("first_year"),
            F.min(F.when(last, F.col("year"))).alias("recent_from"),
            F.max("year").alias("recent_to"),
            F.avg(F.when(last, F.col("anomaly_c"))).alias("recent_mean_c"),
            F.count_if((F.col("_warmest") <= warmest) & (F.col("year") >= since)).alias("recent_records"),
        )
        .withColumn("in_words", describe_vs_average(F.col("recent_mean_c")))
    )


# -- figures over the forecast: a window holds the horizons of one entity


def forecast_week(latest: DataFrame) -> DataFrame:
    """Where each day's range lies within the range of the whole week, from 0 to 100."""
    week = Window.partitionBy(ENTITY)
    low, high = F.min("temperature_low_c").over(week), F.max("temperature_high_c").over(week)
    rows = latest.withColumns({"week_low_c": low, "week_high_c": high})
    width = F.col("week_high_c") - F.col("week_low_c")
    span = F.when(width == 0, F.lit(1.0)).otherwise(width)

    def position(name: str) -> Column:
        return (F.col(name) - F.col("week_low_c")) / span * 100

    return rows.select(
        ENTITY, "target_date", "horizon_days", "week_low_c", "week_high_c",
        position("temperature_low_c").alias("low_position"),
        position("temperature_mid_c").alias("mid_position"),
        position("temperature_high_c").alias("high_position"),
    )


def timeline(recent: DataFrame, latest: DataFrame, days: int = 21) -> DataFrame:
    """Measured days followed by forecast days, each with the usual value for the date."""
    measured = last_rows(recent, ENTITY, DAY, days).select(
        ENTITY, F.col(DAY).alias("day"), F.lit("measured").alias("kind"),
        F.col("temperature_mean_c").alias("value"), F.col("baseline_mean_c").alias("usual"),
    )
    predicted = latest.select(
        ENTITY, F.col("target_date").alias("day"), F.lit("forecast").alias("kind"),
        F.col("temperature_mid_c").alias("value"),
        F.col("temperature_low_c").alias("low"), F.col("temperature_high_c").alias("high"),
        (F.col("temperature_mid_c") - F.col("anomaly_mid_c")).alias("usual"),
    )
    return measured.unionByName(predicted, allowMissingColumns=True)


# -- figures over the skill table


def coverage_percent(skill: DataFrame) -> DataFrame:
    """Mean coverage over the horizons, in whole percent."""
    return skill.agg(F.floor(F.avg("coverage_80") * 100 + 0.5).cast("int").alias("coverage_percent"))


def skill_percent(skill: DataFrame) -> DataFrame:
    """The advantage over the recent normal per horizon, in whole percent."""
    share = F.floor(F.col("skill_vs_recent_normal") * 100 + 0.5).cast("int")
    return skill.select("horizon_days", share.alias("skill_percent"))
