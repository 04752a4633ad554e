"""Leak-free splits, errors against simple forecasts, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.numeric import inside, ordered, round_half_up, skill
from seriesloom.plans.climate import DAY
from seriesloom.schemas import BACKTEST_METRICS, MODEL_SKILL, conform

METRIC_COLUMNS = (
    "mae_model", "mae_persistence", "mae_climatology", "mae_recent_normal",
    "skill_vs_climatology", "skill_vs_persistence", "skill_vs_recent_normal", "coverage_80",
)


def _first_day(year: int) -> Column:
    return F.make_date(F.lit(year), F.lit(1), F.lit(1))


def is_train(test_year: int) -> Column:
    """The target was already known when the test year began."""
    return F.col("target_date") < _first_day(test_year)


def is_test(first_year: int, last_year: int | None = None) -> Column:
    """Observed in a test year, with a target in the same year."""
    last_year = first_year if last_year is None else last_year
    within = (F.col(DAY) >= _first_day(first_year)) & (F.col("target_date") < _first_day(last_year + 1))
    return within & (F.year(DAY) == F.year("target_date"))


def train_rows(long: DataFrame, test_year: int) -> DataFrame:
    return long.where(is_train(test_year))


def test_rows(long: DataFrame, first_year: int, last_year: int | None = None) -> DataFrame:
    """Rows of the test years, with the year.

    A forecast that crosses the end of the year belongs to no test year. Test years do not overlap,
    so one filter gives the rows of all of them.
    """
    return long.where(is_test(first_year, last_year)).withColumn("test_year", F.year(DAY))


def damped_persistence(rows: DataFrame, damping: float = 0.6, half_width: float = 5.0) -> DataFrame:
    """A closed-form forecast: part of today's deviation, with a fixed range around it."""
    mid = F.col("anomaly_lag0") * damping
    return rows.withColumns({"low": mid - half_width, "mid": mid, "high": mid + half_width})


def order_quantiles(rows: DataFrame) -> DataFrame:
    """Put the three quantiles of each row in order."""
    others = [c for c in rows.columns if c not in ("low", "mid", "high")]
    return rows.select(*others, *ordered(("low", "mid", "high")))


def score(rows: DataFrame) -> DataFrame:
    """Errors, skills and coverage per test year and horizon, in one aggregate.

    ``rows`` needs test_year, horizon, target, low, mid, high and the two reference forecasts.
    """
    target = F.col("target")
    errors = rows.groupBy("test_year", "horizon").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.avg(F.abs(target - F.col("mid"))).alias("mae_model"),
        F.avg(F.abs(target - F.col("anomaly_lag0"))).alias("mae_persistence"),
        F.avg(F.abs(target)).alias("mae_climatology"),
        F.avg(F.abs(target - F.col("anomaly_mean_30d"))).alias("mae_recent_normal"),
        F.avg(inside(target, F.col("low"), F.col("high"))).alias("coverage_80"),
    )
    references = ("climatology", "persistence", "recent_normal")
    return conform(
        errors.withColumns({
            f"skill_vs_{r}": skill(F.col("mae_model"), F.col(f"mae_{r}")) for r in references
        }),
        BACKTEST_METRICS,
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Each metric averaged over the test years, per horizon, every year counting the same."""
    return metrics.groupBy("horizon").agg(*[F.avg(c).alias(c) for c in METRIC_COLUMNS])


def model_skill(metrics: DataFrame) -> DataFrame:
    """The published summary per horizon."""
    def mean(column: str) -> Column:
        return round_half_up(F.avg(column), 3)

    return conform(
        metrics.groupBy(F.col("horizon").alias("horizon_days")).agg(
            *[mean(f"mae_{m}").alias(f"mae_{m}_c") for m in ("model", "recent_normal", "persistence", "climatology")],
            mean("skill_vs_recent_normal").alias("skill_vs_recent_normal"),
            mean("coverage_80").alias("coverage_80"),
            F.min("test_year").alias("first_test_year"),
            F.max("test_year").alias("last_test_year"),
            F.sum("test_rows").alias("test_rows"),
        ),
        MODEL_SKILL,
    )
