from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.params import BaselineParams
from seriesloom.plans import climate, normals

PARAMS = BaselineParams(1961, 1990)
FACT = "location_id bigint, weather_date date, temperature_mean_c double, temperature_max_c double"


def facts(spark, years, days=(1, 59, 60, 365, 366), places=2, seed=1):
    draw, rows = random.Random(seed), []
    for place in range(places):
        for year in years:
            for d in days:
                date = datetime.date(year, 1, 1) + datetime.timedelta(days=d - 1)
                if date.year == year:
                    mean = 1e4 + draw.gauss(place, 3)
                    rows.append((place, date, None if draw.random() < 0.05 else mean, mean + draw.random()))
    return spark.createDataFrame(rows, FACT)


def values(df):
    return {(r.location_id, r.day_of_year): (r.mean_c, r.std_c, r.tmax_p90_c) for r in df.collect()}


def same(found, expected):
    assert found.keys() == expected.keys()
    for key, (mean, std, p90) in expected.items():
        assert found[key][0] == pytest.approx(mean, abs=1e-9) and found[key][1] == pytest.approx(std, abs=1e-6) and found[key][2] == p90


def test_states_that_arrive_year_by_year_give_the_normal(spark):
    fact = facts(spark, range(1955, 1995))
    state = None
    for first in (1955, 1963, 1971, 1972, 1985):
        last = {1955: 1963, 1963: 1971, 1971: 1972, 1972: 1985, 1985: 1995}[first]
        part = normals.normal_state(fact.where(F.year("weather_date").between(first, last - 1)), PARAMS)
        state = part if state is None else normals.merged(state, part)
    same(values(normals.reference_days(state, PARAMS)), values(climate.reference_days(fact, PARAMS)))


def test_a_changed_day_renews_its_state_only(spark):
    fact = facts(spark, range(1961, 1991))
    state = normals.normal_state(fact, PARAMS)
    day = datetime.date(1970, 3, 1)
    hit = (F.col("location_id") == 1) & (F.col("weather_date") == day)
    new = fact.withColumns({c: F.when(hit, 2e4).otherwise(F.col(c)) for c in ("temperature_mean_c", "temperature_max_c")})
    after = normals.renewed(state, new, new.where(hit), PARAMS)
    same(values(normals.reference_days(after, PARAMS)), values(climate.reference_days(new, PARAMS)))
    assert values(normals.reference_days(after, PARAMS)) != values(normals.reference_days(state, PARAMS))


def test_rank_error_of_long_states(spark):
    """Many more days than a sketch keeps: the rank of its percentile stays within the stated error."""
    rows = spark.range(40_000).selectExpr("0L as location_id", "date'1961-05-05' as weather_date", "cast(id as double) as temperature_mean_c",
                                          "cast(xxhash64(id) as double) as temperature_max_c")
    parts = [normals.normal_state(rows.where(f"temperature_mean_c % 7 = {k}"), PARAMS) for k in range(7)]
    (found,) = normals.reference_days(normals.merged(*parts), PARAMS).collect()
    below = rows.where(F.col("temperature_max_c") <= found.tmax_p90_c).count() / 40_000
    assert abs(below - 0.9) <= normals.RANK_ERROR
    assert found.mean_c == pytest.approx(19_999.5) and found.std_c == pytest.approx(11547.149, abs=1e-2)


def test_no_days_and_one_day(spark):
    none = normals.normal_state(facts(spark, [1961]).limit(0), PARAMS)
    assert normals.reference_days(normals.merged(none, none), PARAMS).collect() == []
    one = normals.normal_state(facts(spark, [1961], (5,), 1, seed=3), PARAMS)
    (row,) = normals.reference_days(normals.merged(one, none), PARAMS).collect()
    assert row.std_c is None and row.tmax_p90_c is not None
