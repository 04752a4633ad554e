from __future__ import annotations

import datetime
import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seriesloom.operators import runs, series
from tests.helpers import day

START = day("2019-12-20")
KEY = ("k", "d", "hot")
FLAGGED = "k bigint, d date, hot boolean"
RUNS = "k bigint, hot boolean, first_day date, last_day date"
quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
arrivals = st.lists(st.lists(st.tuples(st.sampled_from([1, 2]), st.integers(0, 30) | st.integers(370, 380), st.booleans()),
                             max_size=25, unique_by=lambda x: x[:2]), min_size=1, max_size=4)


def table(spark, rows):
    return spark.createDataFrame([(k, START + datetime.timedelta(days=o), h) for k, o, h in rows], FLAGGED)


def walked(rows):
    """(k, hot, first, last) of every run, by walking through each series."""
    found = []
    for k, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        run = []
        for _, o, h in [*group, (k, 10**6, None)]:
            if run and (run[-1][0] != o - 1 or run[-1][1] != h):
                found.append((k, run[0][1], run[0][0], run[-1][0]))
                run = []
            run.append((o, h))
    return sorted(found)


def got(df):
    return sorted((r.k, r.hot, (r.first_day - START).days, (r.last_day - START).days) for r in df.collect())


@quick
@given(arrivals)
def test_days_in_any_order_give_the_runs_of_all(spark, batches):
    """Appended days, filled gaps and changed flags: after every batch the table is that of all days so far."""
    known = {}
    state = runs.runs_of(table(spark, []), *KEY)
    for batch in batches:
        known |= {(k, o): h for k, o, h in batch}
        state = spark.createDataFrame(runs.advanced(state, table(spark, batch), *KEY).collect(), state.schema)
        assert got(state) == walked([(k, o, h) for (k, o), h in known.items()])


def test_lengths_are_those_of_the_window(spark):
    rows = [(k, o, o % 5 < 2) for k in (1, 2) for o in range(60) if o % 11]
    days = table(spark, rows)
    plain = {(r.k, r.d, r.hot): r.run_length_days for r in series.run_lengths(days, *KEY).collect()}
    stored = runs.days_of(runs.runs_of(days, *KEY), *KEY)
    assert {(r.k, r.d, r.hot): r.run_length_days for r in stored.collect()} == plain


def test_only_runs_beside_the_days_are_touched(spark):
    state = runs.runs_of(table(spark, [(1, o, o // 10 % 2 == 0) for o in range(400)]), *KEY)
    old, new = runs.advance(state, table(spark, [(1, 205, False), (1, 400, True), (2, 5, True)]), *KEY)
    assert got(old) == [(1, False, 390, 399), (1, True, 200, 209)]
    assert got(new) == [(1, False, 205, 205), (1, False, 390, 399), (1, True, 200, 204), (1, True, 206, 209), (1, True, 400, 400), (2, True, 5, 5)]


def test_runs_are_looked_up_without_an_aggregate_or_a_broadcast_of_the_days(spark, monkeypatch):
    """A run that several days touch in several years is found once, and no task holds the days as distinct rows."""
    plans, stored = [], runs.store
    monkeypatch.setattr(runs, "store", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    state = spark.createDataFrame([(1, True, START, START + datetime.timedelta(days=800)), (2, False, START, START)], RUNS)
    wanted = table(spark, [(1, o, False) for o in (3, 4, 100, 400, 700)] + [(2, 1, True)])
    assert got(runs.touched(state, wanted, "k", "d")) == [(1, True, 0, 800), (2, False, 0, 0)]
    assert len(plans) == 1 and "Aggregate" not in plans[0]
    after = runs.advanced(state, wanted, "k", "d", "hot")._jdf.queryExecution().executedPlan().toString()
    assert not any("Broadcast" in plan for plan in (*plans, after))
