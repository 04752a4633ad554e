from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from seriesloom.params import BaselineParams, ServingParams
from seriesloom.plans import climate, dims, features, serving
from seriesloom.schemas import ANOMALY, BASELINE, DIM_DATE, DIM_LOCATION, FACT_DAILY, FEATURES, SERVING, check_schema
from tests.helpers import day, days, tuples, weather

REFERENCE = BaselineParams(first_year=2020, last_year=2021)


def test_fact(spark):
    fact = check_schema(climate.fact_daily(weather(spark, [(1, day("2024-02-29"), 10.0)])), FACT_DAILY)
    assert tuples(fact.select("date_key", "temperature_range_c")) == [(20240229, 10.0)]


def test_date_dimension(spark):
    dim = check_schema(dims.dim_date(dims.default_spine(spark, day("2024-12-30"))), DIM_DATE)
    assert dim.agg(F.min("date_day"), F.max("date_day"), F.countDistinct("date_key")).first()[:2] == (
        day("1940-01-01"), day("2025-12-31"),
    )
    assert dim.count() == dim.select("date_key").distinct().count() == (day("2025-12-31") - day("1940-01-01")).days + 1
    leap = dim.where("date_key = 20241231").first()
    assert (leap.day_of_year, leap.quarter, leap.month_name, leap.season_code) == (366, 4, "December", "DJF")


def test_baseline_frame_is_cut_at_the_ends_of_the_year(spark):
    means = {d: float(d.timetuple().tm_yday) for d in days("2021-01-01", 365)}
    fact = climate.fact_daily(weather(spark, [(1, d, m) for d, m in means.items()]))
    base = check_schema(climate.climate_baseline(fact, REFERENCE), BASELINE)
    found = {r.day_of_year: r.baseline_mean_c for r in base.collect()}
    assert found[1] == statistics.mean(range(1, 9))
    assert found[100] == 100.0
    assert found[365] == statistics.mean(range(358, 366))


def test_the_last_day_of_a_leap_year_counts_as_365(spark):
    rows = [(1, day("2020-12-30"), 1.0), (1, day("2020-12-31"), 3.0), (1, day("2021-12-31"), 5.0)]
    found = tuples(climate.reference_days(climate.fact_daily(weather(spark, rows)), REFERENCE), "day_of_year")
    # 30 December is day 365 in a leap year, 31 December is folded onto it.
    assert [(r[1], r[2]) for r in found] == [(365, 3.0)]


def test_years_outside_the_reference_do_not_count(spark):
    rows = [(1, day("2019-12-31"), 99.0), (1, day("2020-01-01"), 1.0), (1, day("2022-01-01"), 99.0)]
    found = tuples(climate.reference_days(climate.fact_daily(weather(spark, rows)), REFERENCE))
    assert [(r[1], r[2], r[3]) for r in found] == [(1, 1.0, None)]


def baseline_row(spark, *rows):
    return spark.createDataFrame(list(rows), BASELINE)


def test_deviation_edges(spark):
    fact = climate.fact_daily(weather(spark, [
        (1, day("2024-01-01"), 12.0, 20.0),   # exactly at the threshold: not hot
        (2, day("2024-01-01"), 12.0, 20.1),
        (3, day("2024-01-01"), 12.0, 20.0),   # no normal: drops out
        (4, day("2024-01-01"), 12.0, 20.0),
    ]))
    base = baseline_row(spark, (1, 1, 10.0, 4.0, 20.0), (2, 1, 10.0, 0.0, 20.0), (4, 1, 10.0, None, None))
    found = tuples(climate.deviations(fact, base).select("location_id", "anomaly_c", "anomaly_z", "is_hot_day"),
                   "location_id")
    assert found == [(1, 2.0, 0.5, False), (2, 2.0, None, True), (4, 2.0, None, False)]


@pytest.mark.parametrize("split", [False, True])
def test_waves_need_three_days_in_a_row(spark, split):
    hot = ["2023-07-01", "2023-07-02", "2023-07-10", "2023-07-11", "2023-07-12", "2023-07-20", "2023-07-21", "2023-07-23"]
    cold = ["2023-07-03", "2023-07-13"]
    fact = climate.fact_daily(weather(
        spark, [(1, day(d), 20.0, 40.0) for d in hot] + [(1, day(d), 20.0, 10.0) for d in cold]
    ))
    base = baseline_row(spark, *[(1, n, 10.0, 1.0, 30.0) for n in range(1, 366)])
    found = check_schema(climate.climate_anomaly(fact, base, split=split), ANOMALY)
    waves = [str(r.weather_date) for r in found.where("is_heatwave_day").orderBy("weather_date").collect()]
    assert waves == ["2023-07-10", "2023-07-11", "2023-07-12"]
    lengths = {str(r.weather_date): r.hot_run_length_days for r in found.collect()}
    assert lengths["2023-07-02"] == 2 and lengths["2023-07-23"] == 1 and lengths["2023-07-03"] is None


def locations(spark, *ids):
    rows = [(i, f"city {i}", "XX", "X", "R", 10.0 * i, 20.0, 100.0, "UTC", 5, None) for i in ids]
    return spark.createDataFrame(
        rows, "location_id bigint, city string, country_code string, country string, region string, latitude double,"
        " longitude double, elevation_m double, timezone string, population bigint, _file_modified_at timestamp"
    )


def chain(spark, first="2020-01-01", count=800):
    rows = [(1, d, float(d.day % 9 + d.month)) for d in days(first, count)]
    fact = climate.fact_daily(weather(spark, rows))
    base = climate.climate_baseline(fact, REFERENCE)
    return fact, base, climate.climate_anomaly(fact, base)


@pytest.mark.parametrize("split", [False, True])
def test_features_step_by_rows(spark, split):
    fact, _, anomaly = chain(spark)
    table = features.temperature_features(anomaly, fact, locations(spark, 1), split=split)
    rows = check_schema(table, FEATURES).orderBy("weather_date").collect()
    values = [r.anomaly_lag0 for r in rows]
    assert len(rows) == 800
    assert rows[0].anomaly_lag1 is None and rows[0].anomaly_std_7d is None and rows[0].anomaly_mean_7d == values[0]
    assert rows[400].anomaly_lag7 == values[393]
    assert rows[400].target_h7 == values[407] and rows[799].target_h1 is None
    assert rows[400].anomaly_mean_30d == pytest.approx(statistics.mean(values[371:401]))
    assert rows[400].anomaly_std_7d == pytest.approx(statistics.stdev(values[394:401]))
    assert rows[400].precipitation_sum_7d == 7.0 and rows[2].precipitation_sum_7d == 3.0


def test_long_targets(spark):
    fact, _, anomaly = chain(spark, count=40)
    long = features.long_targets(features.temperature_features(anomaly, fact, locations(spark, 1)))
    # The first seven days lack a lag, and the last days lack some targets.
    assert long.count() == 33 * 7 - sum(range(1, 8))
    assert long.where(F.datediff("target_date", "weather_date") != F.col("horizon")).count() == 0
    gaps = features.temperature_features(anomaly, fact, locations(spark, 1).withColumn("elevation_m", F.lit(None).cast("double")))
    assert features.long_targets(gaps).count() == long.count()


def test_serving_tables(spark):
    fact, _, anomaly = chain(spark, count=726)  # ends on 2021-12-26
    dim = check_schema(dims.dim_location(locations(spark, 1, 2)), DIM_LOCATION)
    summary = check_schema(serving.city_summary(dim, anomaly), SERVING["city_summary"]).orderBy("location_id").collect()
    assert (summary[0].days_loaded, summary[0].latest_date, summary[0].has_history) == (726, day("2021-12-26"), True)
    assert (summary[1].days_loaded, summary[1].anomaly_30d_c, summary[1].has_history) == (None, None, False)
    recent = [r.anomaly_c for r in anomaly.orderBy(F.col("weather_date").desc()).limit(30).collect()]
    assert summary[0].anomaly_30d_c == pytest.approx(statistics.mean(recent), abs=0.006)
    latest = check_schema(serving.city_recent_daily(anomaly, fact), SERVING["city_recent_daily"])
    assert latest.count() == 90 and latest.agg(F.max("weather_date")).first()[0] == day("2021-12-26")
    yearly = check_schema(serving.city_yearly(anomaly, fact), SERVING["city_yearly"]).orderBy("year").collect()
    assert [(r.year, r.days, r.is_complete_year) for r in yearly] == [(2020, 366, True), (2021, 360, True)]
    short = serving.city_yearly(anomaly.where("weather_date < '2021-12-26'"), fact)
    assert [r.is_complete_year for r in short.orderBy("year").collect()] == [True, False]
    assert ServingParams().recent_days == 90
