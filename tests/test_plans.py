"""What the physical plans may and may not contain."""

from __future__ import annotations

import re

import pytest

from checks import proxy
from checks.queries import CHECKS, Gold
from seriesloom.plans import climate, reads, serving

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def gold(spark):
    return Gold(spark, FOLDER)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_layers_need_no_shuffle(gold, no_broadcast):
    base = climate.climate_baseline(gold.fact, proxy.BASELINE)
    days = climate.climate_anomaly(gold.fact, base)
    for df in (base, days, serving.series_history(days), serving.city_yearly(days, gold.fact),
               serving.city_recent_daily(days, gold.fact)):
        assert "Exchange" not in plan(df)


def test_reference_years_reach_the_scan(gold):
    text = plan(climate.reference_days(gold.fact, proxy.BASELINE))
    assert "GreaterThanOrEqual(weather_date,1995-01-01)" in text and "LessThanOrEqual(weather_date,1998-12-31)" in text
    assert re.search(r"ReadSchema: struct<location_id:bigint,weather_date:date,temperature_max_c:double,temperature_mean_c", text)


def test_point_reads_reach_the_scan(spark, gold, folder):
    serving.city_yearly(gold.anomaly, gold.fact).write.parquet(f"{folder}/yearly")
    assert "EqualTo(location_id,7)" in plan(reads.read_entity(spark.read.parquet(f"{folder}/yearly"), 7, "year"))


def test_latest_reduces_before_the_shuffle(spark):
    text = plan(CHECKS["latest_event"].run(spark, FOLDER))
    assert text.count("max_by") >= 2 and "partial_max_by" in text


@pytest.mark.parametrize("name", [
    "anomaly", "feature_table", "city_summary", "city_yearly", "forecast_rows", "backtest_metrics", "timeline",
    "resolve_locations", "backfill_plan", "orphans",
])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(CHECKS[name].run(spark, FOLDER))
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
