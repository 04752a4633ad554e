"""Daily facts, the climate normal, and the deviation from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.calendar import date_key, folded_day, in_years
from seriesloom.functions.numeric import round_half_up, safe_ratio
from seriesloom.operators.series import RUN_LENGTH, centred_mean, run_lengths, run_lengths_split
from seriesloom.params import BaselineParams, RunParams
from seriesloom.schemas import ANOMALY, BASELINE, FACT_DAILY, conform

ENTITY = "location_id"
DAY = "weather_date"


def fact_daily(weather: DataFrame) -> DataFrame:
    """Daily measurements with their date key and temperature range."""
    return conform(
        weather.withColumns({
            "date_key": date_key(F.col(DAY)),
            "temperature_range_c": F.col("temperature_max_c") - F.col("temperature_min_c"),
        }),
        FACT_DAILY,
    )


def reference_days(fact: DataFrame, params: BaselineParams = BaselineParams()) -> DataFrame:
    """Mean, spread and hot threshold per entity and day of the year, before smoothing.

    A group holds at most one row per reference year, well below the size up to which the
    approximate percentile is exact.
    """
    return (
        fact.where(in_years(F.col(DAY), params.first_year, params.last_year))
        .groupBy(ENTITY, folded_day(F.col(DAY)).alias("day_of_year"))
        .agg(
            F.avg("temperature_mean_c").alias("mean_c"),
            F.stddev_samp("temperature_mean_c").alias("std_c"),
            F.percentile_approx("temperature_max_c", params.hot_percentile).alias("tmax_p90_c"),
        )
    )


def climate_baseline(fact: DataFrame, params: BaselineParams = BaselineParams()) -> DataFrame:
    """The smoothed normal. A window holds at most 365 rows; it does not wrap around the year."""
    near = Window.partitionBy(ENTITY).orderBy("day_of_year")
    smooth = {
        "baseline_mean_c": "mean_c",
        "baseline_std_c": "std_c",
        "baseline_tmax_p90_c": "tmax_p90_c",
    }
    return conform(
        reference_days(fact, params).select(
            ENTITY, "day_of_year",
            *[centred_mean(source, near, params.smooth_rows).alias(name) for name, source in smooth.items()],
        ),
        BASELINE,
    )


def deviations(fact: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each fact next to its normal; days of entities without a normal drop out.

    The join is on (entity, day of the year), so a long series is spread over many keys.
    """
    facts = fact.select(
        ENTITY, "date_key", DAY, "temperature_mean_c", "temperature_max_c",
        folded_day(F.col(DAY)).alias("day_of_year"),
    )
    raw = F.col("temperature_mean_c") - F.col("baseline_mean_c")
    hot = F.coalesce(F.col("temperature_max_c") > F.col("baseline_tmax_p90_c"), F.lit(False))
    return facts.join(baseline, [ENTITY, "day_of_year"]).select(
        ENTITY, "date_key", DAY, "temperature_mean_c", "temperature_max_c", "baseline_mean_c",
        round_half_up(raw, 2).alias("anomaly_c"),
        round_half_up(safe_ratio(raw, F.col("baseline_std_c")), 2).alias("anomaly_z"),
        hot.alias("is_hot_day"),
    )


def flag_waves(runs: DataFrame, params: RunParams = RunParams()) -> DataFrame:
    """Hot runs that are long enough, and their length on hot days only."""
    hot, length = F.col("is_hot_day"), F.col(RUN_LENGTH)
    return conform(
        runs.withColumns({
            "is_heatwave_day": hot & (length >= params.wave_days),
            "hot_run_length_days": F.when(hot, length),
        }),
        ANOMALY,
    )


def climate_anomaly(
    fact: DataFrame, baseline: DataFrame, params: RunParams = RunParams(), split: bool = False
) -> DataFrame:
    """Deviation from the normal, hot days, and the runs they form.

    ``split`` never puts more than a year of an entity into one task; it reads the deviations twice.
    """
    lengths = run_lengths_split if split else run_lengths
    return flag_waves(lengths(deviations(fact, baseline), ENTITY, DAY, "is_hot_day"), params)
