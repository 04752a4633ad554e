"""Feature table, horizons and training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from seriesloom.functions.calendar import cycle
from seriesloom.operators.series import trailing, window_columns
from seriesloom.params import FEATURE_COLUMNS, HORIZONS, REQUIRED_FEATURES
from seriesloom.plans.climate import DAY, ENTITY
from seriesloom.schemas import FEATURES, conform

LAGS = (1, 2, 3, 7)
LONGEST_FRAME = 30


def _series_columns(window: WindowSpec) -> list[Column]:
    """Everything that looks at neighbouring rows; one sort serves all of it."""
    lags = [F.lag("anomaly_c", n).over(window).alias(f"anomaly_lag{n}") for n in LAGS]
    targets = [F.lead("anomaly_c", h).over(window).alias(f"target_h{h}") for h in HORIZONS]
    return [
        *lags,
        trailing(F.avg("anomaly_c"), window, 7).alias("anomaly_mean_7d"),
        trailing(F.avg("anomaly_c"), window, LONGEST_FRAME).alias("anomaly_mean_30d"),
        trailing(F.stddev_samp("anomaly_c"), window, 7).alias("anomaly_std_7d"),
        trailing(F.sum("precipitation_mm"), window, 7).alias("precipitation_sum_7d"),
        *targets,
    ]


def temperature_features(anomaly: DataFrame, fact: DataFrame, locations: DataFrame, split: bool = False) -> DataFrame:
    """What is known on a day, and the deviations of the seven days after it."""
    measured = fact.select(ENTITY, DAY, "precipitation_mm", "wind_gust_max_kmh", "temperature_range_c")
    place = locations.select(ENTITY, "latitude", "elevation_m")
    base = (
        anomaly.select(ENTITY, DAY, "anomaly_c")
        .join(measured, [ENTITY, DAY])
        .join(place, ENTITY)
    )
    sine, cosine = cycle(F.dayofyear(DAY))
    rows = window_columns(base, ENTITY, DAY, _series_columns, back=LONGEST_FRAME - 1, ahead=max(HORIZONS), split=split)
    return conform(
        rows.withColumns({"anomaly_lag0": F.col("anomaly_c"), "doy_sin": sine, "doy_cos": cosine}), FEATURES
    )


def usable(features: DataFrame) -> DataFrame:
    """Days with enough history behind them."""
    return features.na.drop(subset=list(REQUIRED_FEATURES))


def at_horizons() -> tuple[str, dict[int, dict[str, Column]]]:
    """What ``long_targets`` adds to a day at each horizon, as variants of one row."""
    return "horizon", {h: {"target": F.col(f"target_h{h}"), "target_date": F.date_add(F.col(DAY), h)} for h in HORIZONS}


def long_targets(features: DataFrame) -> DataFrame:
    """One row per entity, day and horizon, from one pass over the feature table.

    Rows without a target or without enough history are left out; other gaps stay.
    """
    targets = [f"target_h{h}" for h in HORIZONS]
    kept = [c for c in features.columns if c not in targets]
    pairs = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(t).alias("target")) for h, t in zip(HORIZONS, targets, strict=True)
    ])
    long = (
        usable(features)
        .select(*kept, F.inline(pairs))
        .where(F.col("target").isNotNull())
    )
    return long.withColumn("target_date", F.date_add(F.col(DAY), F.col("horizon")))


def with_horizons(rows: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Each row once per horizon."""
    return rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))


def since_year(rows: DataFrame, first_year: int) -> DataFrame:
    """Rows from the first of January of a year on, as a date filter."""
    return rows.where(F.col(DAY) >= F.make_date(F.lit(first_year), F.lit(1), F.lit(1)))


def model_inputs(rows: DataFrame) -> DataFrame:
    """The model's columns as doubles."""
    return rows.select(*[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS])
