from __future__ import annotations

import dataclasses
import datetime
import json
import math
import os

import pytest

from seriesloom.operators.quality import QualityError
from seriesloom.params import BacktestParams, BaselineParams, BoostParams
from seriesloom.pipeline import Pipeline, PipelineParams
from seriesloom.plans import climate, publish
from seriesloom.schemas import SERVING, check_schema
from seriesloom.streaming import silver
from tests.helpers import day, days
from tests.test_streaming import NAMES

PARAMS = PipelineParams(
    baseline=BaselineParams(2020, 2021), backtest=BacktestParams(2020, (2022,)), buckets=4,
    boost=BoostParams(rounds=2, depth=2, learning_rate=0.5, min_leaf=20),
)
NOW = datetime.datetime(2023, 1, 8, 5, 30, tzinfo=datetime.UTC)


def put(folder, name, *records):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)


def place(number):
    return {"id": number, "name": f"city {number}", "country_code": "XX", "country": "X", "admin1": "R",
            "latitude": 10.0 * number, "longitude": 5.0, "elevation": 50.0, "timezone": "UTC", "population": 7}


def reply(number, stamp, dates):
    mean = [10 + 8 * math.sin(d.timetuple().tm_yday / 58) + (d.toordinal() * (number + 3)) % 7 for d in dates]
    values = [[m + 5 for m in mean], [m - 5 for m in mean], mean, [1.0] * len(mean), [20.0] * len(mean)]
    daily = {"time": [str(d) for d in dates], **dict(zip(NAMES, values, strict=True))}
    return {"location_id": number, "extracted_at": stamp, "payload": {"daily": daily}}


def test_daily_refresh(spark, folder):
    first = Pipeline(spark, folder, "one", PARAMS, "loomtest")
    put(first.landing("locations"), "l1", place(1), place(2), place(3))
    history = days("2020-01-01", 1095)
    for n in (1, 2):
        put(first.landing("weather_daily"), f"w{n}", reply(n, "20230101T000000Z", history))
    first.refresh_silver()
    first.build_gold(day("2023-01-01"))
    first.backtest()
    assert first.train() == 1
    # A session that knows none of the tables finds the layers again.
    for name in ("features_temperature", "fact_daily", "climate_baseline", "fact_climate_anomaly", "dim_location"):
        for layer in ("gold", "ml"):
            spark.sql(f"drop table if exists loomtest_{layer}_{name}_one")
    first = Pipeline(spark, folder, "one", PARAMS, "loomtest")
    plan = first.table("gold", "fact_daily").groupBy("location_id").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    first.score()
    first.publish(NOW)
    counts = silver.read_metrics(spark, first.expectations)
    assert {(r.table_name, r.metric): r.amount for r in counts.collect()}[("weather_daily", "replies")] == 2
    live = {n: check_schema(publish.live_table(spark, first.live, n), s) for n, s in SERVING.items()}
    assert {n: t.count() for n, t in live.items()} == {
        "city_summary": 3, "city_yearly": 6, "city_recent_daily": 180, "forecast_latest": 14, "model_skill": 7,
    }
    assert live["city_summary"].where("not has_history").count() == 1

    # A later reply revises the last two weeks and adds five days for one place.
    # This run also takes the form for long series; it must give the same rows.
    second = Pipeline(spark, folder, "two", dataclasses.replace(PARAMS, split=True), "loomtest")
    put(second.landing("weather_daily"), "w3", reply(1, "20230107T000000Z", days("2022-12-18", 18)))
    second.refresh(day("2023-01-07"), NOW)
    assert second.fact.read().count() == 2 * 1095 + 5
    latest = publish.live_table(spark, second.live, "forecast_latest")
    assert {(r.location_id, r.forecast_made_date) for r in latest.collect()} == {
        (1, day("2023-01-04")), (2, day("2022-12-30")),
    }
    assert second.forecasts.read().count() == 21
    facts, base = second.table("gold", "fact_daily"), second.table("gold", "climate_baseline")
    stored, plain = second.table("gold", "fact_climate_anomaly"), climate.climate_anomaly(facts, base)
    assert stored.count() == plain.count() and stored.exceptAll(plain).isEmpty()
    assert publish.live_folder(spark, second.live).endswith("run=two")

    # A place that is not in the dimension fails the relationship test, and nothing is published.
    third = Pipeline(spark, folder, "three", PARAMS, "loomtest")
    put(third.landing("weather_daily"), "w4", reply(9, "20230108T000000Z", history))
    with pytest.raises(QualityError, match="fact_weather_daily.location_id relationship: 1095"):
        third.refresh(day("2023-01-08"), NOW)
    assert publish.live_folder(spark, third.live).endswith("run=two")
    # The old layers are still the current ones.
    assert third.table("gold", "climate_baseline").exceptAll(second.table("gold", "climate_baseline")).isEmpty()
    assert {r.run for r in third.layers.read().collect()} == {"two"}
