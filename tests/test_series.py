from __future__ import annotations

import datetime
import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.operators import series
from seriesloom.plans.features import _series_columns
from tests.helpers import day, days, tuples

START = day("2019-12-20")
FLAGGED = "k bigint, d date, hot boolean"
quick = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
# Days over several years, dense enough to form runs across the turn of a year.
offsets = st.lists(st.tuples(st.sampled_from([1, 2]), st.integers(0, 40) | st.integers(360, 390), st.booleans()),
                   min_size=1, max_size=120, unique_by=lambda x: x[:2])


def flagged(spark, rows):
    return spark.createDataFrame([(k, START + datetime.timedelta(days=o), h) for k, o, h in rows], FLAGGED)


def brute_runs(rows):
    """Run length of every row, by walking through each series."""
    found = {}
    for k, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        run = []
        for _, o, h in group:
            if run and (run[-1][0] != o - 1 or run[-1][1] != h):
                run = []
            run.append((o, h))
            for member, _ in run:
                found[(k, member)] = len(run)
    return found


@quick
@given(offsets)
def test_runs_match_brute_force(spark, rows):
    expected = brute_runs(rows)
    for function in (series.run_lengths, series.run_lengths_split):
        found = {
            (r["k"], (r["d"] - START).days): r["run_length_days"]
            for r in function(flagged(spark, rows), "k", "d", "hot").collect()
        }
        assert found == expected


def test_a_run_may_span_whole_years(spark):
    rows = [(1, d, True) for d in days("2018-11-01", 900)]
    df = spark.createDataFrame(rows, FLAGGED)
    found = series.run_lengths_split(df, "k", "d", "hot")
    assert tuples(found.groupBy("run_length_days").count()) == [(900, 900)]


def test_a_missing_day_ends_a_run(spark):
    rows = [(1, d, True) for d in days("2024-03-01", 2)] + [(1, day("2024-03-04"), True)]
    lengths = [r[3] for r in tuples(series.run_lengths(spark.createDataFrame(rows, FLAGGED), "k", "d", "hot"), "d")]
    assert lengths == [2, 2, 1]


@quick
@given(offsets)
def test_split_frames_equal_plain_ones(spark, rows):
    values = [(k, START + datetime.timedelta(days=o), float(o % 7), float(h)) for k, o, h in rows]
    df = spark.createDataFrame(values, "k bigint, d date, anomaly_c double, precipitation_mm double")
    plain = series.window_columns(df, "k", "d", _series_columns, back=29, ahead=7)
    split = series.window_columns(df, "k", "d", _series_columns, back=29, ahead=7, split=True, block_rows=29)
    assert tuples(plain, "k", "d") == tuples(split.select(*plain.columns), "k", "d")


def test_full_moving_mean(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 13)], "k bigint, d int, v double")
    window = series.by_day("k", "d")
    found = [r[0] for r in df.select(series.full_moving_mean("v", window, 10), "d").orderBy("d").collect()]
    assert found == [None] * 9 + [5.5, 6.5, 7.5]


def test_last_rows_and_newest_row(spark):
    rows = [(k, d, i) for k in (1, 2) for i, d in enumerate(days("2024-01-01", 30))]
    df = spark.createDataFrame(rows, "k bigint, d date, v int")
    last = series.last_rows(df, "k", "d", 21)
    assert tuples(last.groupBy("k").agg(F.min("v"), F.count("*")), "k") == [(1, 9, 21), (2, 9, 21)]
    assert tuples(series.newest_row(df, "k", "d"), "k") == [(1, day("2024-01-30"), 29), (2, day("2024-01-30"), 29)]
    assert series.largest_series(df, "k") == 30


def test_within_days_gives_exactly_that_many(spark):
    df = spark.createDataFrame([(d,) for d in days("2024-01-01", 60)], "d date")
    assert df.where(series.within_days(F.col("d"), F.lit(day("2024-02-29")), 30)).count() == 30
