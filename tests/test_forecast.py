from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seriesloom.plans import backtest, features, forecast, serving
from seriesloom.schemas import BACKTEST_METRICS, BASELINE, FORECAST, MODEL_SKILL, SERVING, check_schema
from tests.helpers import day, tuples

LONG = ("location_id bigint, weather_date date, horizon int, target double, target_date date, anomaly_lag0 double,"
        " anomaly_mean_30d double")


def long_row(place, made, horizon, target, lag0=0.0, mean=0.0):
    import datetime

    return (place, day(made), horizon, target, day(made) + datetime.timedelta(days=horizon), lag0, mean)


def test_split_has_no_leak(spark):
    rows = [long_row(1, d, h, 1.0) for d in ("2022-12-24", "2022-12-30", "2023-01-01", "2023-12-24", "2023-12-28", "2024-01-01")
            for h in range(1, 8)]
    long = spark.createDataFrame(rows, LONG)
    train, test = backtest.train_rows(long, 2023), backtest.test_rows(long, 2023)
    assert train.agg(F.max("target_date")).first()[0] == day("2022-12-31")
    assert train.count() == 7 + 1
    assert test.agg(F.min("weather_date"), F.max("target_date")).first()[:] == (day("2023-01-01"), day("2023-12-31"))
    # 28 December: only three horizons end within the year; the year before belongs to no test.
    assert test.count() == 7 + 7 + 3
    assert tuples(backtest.test_rows(long, 2022, 2024).groupBy("test_year").count(), "test_year") == [
        (2022, 7 + 1), (2023, 17), (2024, 7),
    ]


def test_score(spark):
    rows = [long_row(1, "2023-05-01", 1, 2.0, 1.0, 4.0), long_row(1, "2023-05-02", 1, -2.0, 1.0, 0.0)]
    scored = spark.createDataFrame(rows, LONG).withColumns({
        "test_year": F.lit(2023), "low": F.lit(-2.0), "mid": F.lit(1.0), "high": F.lit(1.9),
    })
    metrics = check_schema(backtest.score(scored), BACKTEST_METRICS).first()
    assert metrics[:7] == (2023, 1, 2, 2.0, 2.0, 2.0, 2.0)
    assert metrics.skill_vs_climatology == 0.0 and metrics.coverage_80 == 0.5


def test_zero_reference_error_gives_no_skill(spark):
    rows = spark.createDataFrame([long_row(1, "2023-05-01", 1, 0.0, 1.0, 1.0)], LONG)
    metrics = backtest.score(backtest.damped_persistence(rows.withColumn("test_year", F.lit(2023)))).first()
    assert metrics.skill_vs_climatology is None and metrics.skill_vs_persistence == pytest.approx(0.4)


def test_skill_summary_weights_years_equally(spark):
    rows = [(2023, 1, 10, 1.0, 2.0, 3.0, 4.0, 0.5, 0.5, 0.75, 0.8), (2024, 1, 1000, 2.0, 2.0, 3.0, 4.0, 0.5, 0.5, 0.5, 0.7)]
    skill = check_schema(backtest.model_skill(spark.createDataFrame(rows, BACKTEST_METRICS)), MODEL_SKILL)
    assert tuples(skill) == [(1, 1.5, 4.0, 2.0, 3.0, 0.625, 0.75, 2023, 2024, 1010)]


def feature_rows(spark, *rows):
    return spark.createDataFrame(
        list(rows), "location_id bigint, weather_date date, anomaly_lag0 double, anomaly_lag7 double,"
        " anomaly_std_7d double, target_h1 double",
    )


def crossed(rows):
    return rows.withColumns({"low": F.lit(3.0), "mid": F.lit(1.0), "high": F.lit(2.0)})


def make(spark, **changes):
    table = feature_rows(
        spark,
        (1, day("2024-12-28"), 1.0, 1.0, 1.0, 9.0), (1, day("2024-12-29"), 2.0, 1.0, 1.0, None),
        (1, day("2024-12-30"), 3.0, None, 1.0, None),  # not enough history
        (2, day("2024-03-01"), 1.0, 1.0, 1.0, None),   # no normal
    )
    base = spark.createDataFrame([(1, d, 10.0, 1.0, 20.0) for d in (1, 2, 3, 4, 5, 365)], BASELINE)
    return check_schema(forecast.make_forecast(table, base, crossed, "m", 3), FORECAST)


def test_forecast_rows(spark):
    made = make(spark)
    one = made.where("location_id = 1").orderBy("horizon_days").collect()
    assert [r.horizon_days for r in one] == list(features.HORIZONS)
    assert {r.forecast_made_date for r in one} == {day("2024-12-29")}
    assert [r.date_key for r in one[:3]] == [20241230, 20241231, 20250101]
    assert (one[0].anomaly_low_c, one[0].anomaly_mid_c, one[0].anomaly_high_c) == (1.0, 2.0, 3.0)
    assert (one[0].temperature_low_c, one[0].temperature_high_c, one[0].model_version) == (11.0, 13.0, 3)
    other = made.where("location_id = 2").collect()
    assert len(other) == 7 and all(r.temperature_mid_c is None and r.anomaly_mid_c == 2.0 for r in other)


def test_scoring_twice_leaves_one_set_of_rows(spark, folder):
    target = forecast.forecast_table(spark, f"{folder}/f")
    for _ in range(2):
        forecast.store_forecast(target, make(spark))
    assert target.read().count() == 14
    latest = check_schema(serving.forecast_latest(target.read()), SERVING["forecast_latest"])
    assert latest.count() == 14


def test_latest_forecast_only(spark):
    made = make(spark)
    older = made.withColumn("forecast_made_date", F.date_sub("forecast_made_date", 1))
    assert serving.forecast_latest(made.unionByName(older)).agg(F.min("forecast_made_date")).first()[0] == day("2024-03-01")
