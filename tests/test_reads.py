from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import quality
from seriesloom.params import PlanningParams
from seriesloom.plans import planning, reads
from seriesloom.schemas import CITY_YEARLY, conform
from tests.helpers import day, tuples

SUMMARY = ("location_id bigint, city string, latest_date date, anomaly_30d_c double, has_history boolean")


def summary(spark, *rows):
    return spark.createDataFrame(list(rows), SUMMARY)


def cities(spark):
    return summary(
        spark, (1, "Berlin", day("2024-01-10"), -3.0, True), (2, "Accra", day("2024-01-09"), 1.0, True),
        (3, "Lima", None, None, False), (4, "Oslo", day("2024-01-08"), 8.0, True), (5, "Bonn", day("2024-01-08"), 0.1, True),
    )


def test_standouts_and_default(spark):
    assert [r[:4] for r in tuples(reads.standouts(cities(spark)))] == [
        (4, "Oslo", 8.0, "8.0 °C warmer than usual"), (1, "Berlin", -3.0, "3.0 °C colder than usual"),
        (2, "Accra", 1.0, "1.0 °C warmer than usual"),
    ]
    assert tuples(reads.default_entity(cities(spark))) == [(4, "Oslo")]
    unknown = cities(spark).withColumn("anomaly_30d_c", F.lit(None).cast("double"))
    assert tuples(reads.default_entity(unknown)) == [(2, "Accra")]
    assert reads.default_entity(unknown.where("not has_history")).count() == 0


def test_menu_puts_ready_entities_first(spark):
    assert [r[1] for r in reads.entity_menu(cities(spark)).collect()] == ["Accra", "Berlin", "Bonn", "Oslo", "Lima"]


def test_progress(spark):
    row = reads.load_progress(cities(spark), datetime.date(2023, 1, 1)).first()
    # 375 days times four places, to the nearest thousand.
    assert row[:] == (5, 4, day("2024-01-10"), 2000)


def test_entity_reads(spark):
    table = spark.createDataFrame([(1, 2, float("nan")), (1, 1, 2.0), (2, 1, 3.0)], "location_id bigint, year int, v double")
    assert tuples(reads.require_rows(reads.read_entity(table, 1, "year"))) == [(1, 1, 2.0), (1, 2, None)]
    with pytest.raises(reads.NoRows):
        reads.require_rows(reads.read_entity(table, 9, "year"))


def yearly(spark, years, place=1, complete=lambda y: True):
    rows = [(place, y, 365, complete(y), 10.0, (y % 17) / 10, 30.0, 1, 0, 5.0) for y in years]
    return conform(spark.createDataFrame(rows, CITY_YEARLY), CITY_YEARLY)


def test_long_view_needs_twenty_full_years(spark):
    table = yearly(spark, range(2000, 2019)).unionByName(yearly(spark, range(1995, 2025), 2, lambda y: y < 2024))
    rows = reads.long_view(table).collect()
    assert [r.location_id for r in rows] == [2]
    row = rows[0]
    years = list(range(1995, 2024))
    warmest = sorted(years, key=lambda y: (-(y % 17), y))[:10]
    assert (row.first_year, row.recent_from, row.recent_to) == (1995, 2014, 2023)
    assert row.recent_mean_c == pytest.approx(sum(y % 17 for y in range(2014, 2024)) / 100)
    assert row.recent_records == sum(y >= 2010 for y in warmest)


def test_moving_average_and_warmest(spark):
    table = yearly(spark, range(2000, 2012))
    assert [r.moving_mean is None for r in reads.moving_average(table).orderBy("year").collect()] == [True] * 9 + [False] * 3
    assert reads.warmest_years(table).count() == 10
    # A year that is not complete takes no part, however warm it is.
    with_part = table.unionByName(yearly(spark, range(2012, 2013), 1, lambda y: False).withColumn("anomaly_c", F.lit(99.0)))
    assert reads.warmest_years(with_part).exceptAll(reads.warmest_years(table)).isEmpty()
    assert reads.moving_average(with_part).count() == 12 and reads.year_scale(with_part).count() == 12


FORECAST = ("location_id bigint, target_date date, horizon_days int, temperature_low_c double, temperature_mid_c double,"
            " temperature_high_c double, anomaly_mid_c double")


def test_week_positions(spark):
    rows = [(1, day("2024-01-01"), 1, 0.0, 5.0, 10.0, 1.0), (1, day("2024-01-02"), 2, 5.0, 10.0, 20.0, 1.0),
            (2, day("2024-01-01"), 1, 7.0, 7.0, 7.0, 1.0)]
    week = tuples(reads.forecast_week(spark.createDataFrame(rows, FORECAST)), "location_id", "horizon_days")
    assert [r[3:] for r in week] == [(0.0, 20.0, 0.0, 25.0, 50.0), (0.0, 20.0, 25.0, 50.0, 100.0), (7.0, 7.0, 0.0, 0.0, 0.0)]


def test_timeline(spark):
    recent = spark.createDataFrame(
        [(1, day("2024-01-01") + datetime.timedelta(days=i), float(i), 1.0) for i in range(30)],
        "location_id bigint, weather_date date, temperature_mean_c double, baseline_mean_c double",
    )
    latest = spark.createDataFrame([(1, day("2024-01-31"), 1, 0.0, 5.0, 10.0, 1.5)], FORECAST)
    rows = reads.timeline(recent, latest).orderBy("day").collect()
    assert len(rows) == 22 and rows[0].day == day("2024-01-10")
    assert (rows[-1].kind, rows[-1].usual, rows[-1].low, rows[0].low) == ("forecast", 3.5, 0.0, None)


def test_percentages(spark):
    skill = spark.createDataFrame([(1, 0.355, 0.775), (2, 0.0449, 0.80)], "horizon_days int, skill_vs_recent_normal double, coverage_80 double")
    assert tuples(reads.skill_percent(skill), "horizon_days") == [(1, 36), (2, 4)]
    assert tuples(reads.coverage_percent(skill)) == [(79,)]


# -- planning

PLAN = PlanningParams(history_start="2020-01-01", max_backfills=2)


def test_backfill_plan(spark):
    entities = spark.createDataFrame([(i, 10 - i) for i in range(1, 7)], "location_id bigint, list_position int")
    stored = spark.createDataFrame(
        [(1, day("2020-02-01")), (1, day("2024-01-01")), (2, day("2020-02-02"))], "location_id bigint, weather_date date"
    )
    plan = tuples(planning.backfill_plan(entities, stored, day("2024-06-20"), PLAN), "request", "location_id")
    end = day("2024-06-14")
    assert plan == [
        (5, "backfill", day("2020-01-01"), end), (6, "backfill", day("2020-01-01"), end),
        (1, "refresh", day("2024-05-31"), end),
    ]
    everything_new = planning.backfill_plan(entities, None, day("2024-06-20"), PLAN)
    assert everything_new.where("request = 'backfill'").count() == everything_new.count() == 2


CANDIDATE = ("requested_city string, requested_country_code string, country_code string, id bigint, population bigint,"
             " reply_position int")


def test_best_candidate(spark):
    candidates = spark.createDataFrame([
        ("A", "X", "X", 1, None, 0), ("A", "X", "X", 2, 5, 1), ("A", "X", "Y", 3, 999, 2),
        ("B", "X", "X", 4, None, 0), ("B", "X", "X", 5, None, 1), ("C", "X", "Y", 6, 1, 0),
    ], CANDIDATE)
    requested = spark.createDataFrame([("A", "X"), ("B", "X")], "city string, country_code string")
    resolved = planning.require_resolved(planning.resolve_locations(requested, candidates))
    assert tuples(resolved.select("requested_city", "id"), "requested_city") == [("A", 2), ("B", 4)]
    missing = spark.createDataFrame([("C", "X"), ("D", "X")], "city string, country_code string")
    with pytest.raises(planning.Unresolved, match=r"C \(X\)"):
        planning.require_resolved(planning.resolve_locations(missing, candidates))


# -- quality


def test_table_tests(spark):
    fact = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (7, 3), (7, 4)], "k bigint, d int")
    dim = spark.createDataFrame([(1,), (2,)], "k bigint")
    checks = quality.report([
        quality.not_null("f", fact, ("k", "d")), quality.unique("f", fact, ("k", "d")), quality.relationship("f", fact, "k", dim),
    ])
    found = {(r.check_name, r.column_names): r.violations for r in checks.collect()}
    assert found == {("not_null", "k"): 1, ("not_null", "d"): 0, ("unique", "k,d"): 1, ("relationship", "k"): 2}
    with pytest.raises(quality.QualityError, match="f.k not_null: 1; f.k relationship: 2; f.k,d unique: 1"):
        quality.require(checks)
    quality.require(checks.where("violations = 0"))
    assert tuples(quality.orphans(fact, "k", dim)) == [(7, 2)]


def test_null_predicates_are_violations(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "x double")
    assert tuples(quality.drop_violations(df, {"positive": "x > 0"})) == [(1.0,)]
    assert tuples(quality.count_violations(df, {"positive": "x > 0"})) == [(3, 2)]
    watched, seen = quality.observe_violations(df, "watch", {"positive": "x > 0"})
    assert watched.count() == 3 and seen.get == {"row_count": 3, "positive": 2}


def test_staleness(spark):
    now = datetime.datetime(2024, 1, 2, 12, tzinfo=datetime.UTC)
    exports = spark.sql("select timestamp'2024-01-01 06:00:00' as exported_at")
    quality.require_fresh(exports, "exported_at", now)
    for stale in (exports.selectExpr("exported_at - interval 1 second as exported_at"), exports.limit(0)):
        with pytest.raises(quality.QualityError):
            quality.require_fresh(stale, "exported_at", now)
