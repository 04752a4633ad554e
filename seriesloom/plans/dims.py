"""Dimensions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import calendar, geography
from seriesloom.schemas import DIM_DATE, DIM_LOCATION, conform

FIRST_DAY = datetime.date(1940, 1, 1)


def date_spine(spark: SparkSession, first: datetime.date, last: datetime.date) -> DataFrame:
    """Every day from ``first`` to ``last``, made in parallel; bounded by the calendar."""
    days = (last - first).days + 1
    return spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date_day"))


def dim_date(spine: DataFrame) -> DataFrame:
    """Calendar attributes of each day of a spine."""
    day = F.col("date_day")
    return conform(
        spine.select(
            calendar.date_key(day).alias("date_key"),
            day,
            F.year(day).alias("year"),
            F.quarter(day).alias("quarter"),
            F.month(day).alias("month"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.dayofmonth(day).alias("day_of_month"),
            F.dayofyear(day).alias("day_of_year"),
            calendar.decade(day).alias("decade"),
            calendar.season(day).alias("season_code"),
        ),
        DIM_DATE,
    )


def default_spine(spark: SparkSession, today: datetime.date) -> DataFrame:
    """From 1940 to one year and a day past ``today``."""
    return date_spine(spark, FIRST_DAY, today + datetime.timedelta(days=366))


def dim_location(locations: DataFrame) -> DataFrame:
    latitude = F.col("latitude")
    banded = locations.withColumns(
        {"hemisphere": geography.hemisphere(latitude), "latitude_band": geography.latitude_band(latitude)}
    )
    return conform(banded, DIM_LOCATION)
