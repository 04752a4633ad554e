"""Runs of flagged days as a small table that new days change only where they touch it.

A run is one row: entity, flag, first and last day. Days that arrive, in any order, change only the runs that hold one of them or
lie next to one: those are laid out in days, the new days replace or join them, and the days are put together anew. A day that
is appended makes a run longer, a day that fills a gap joins two, and one whose flag changes cuts a run in two. So the work
of a refresh follows the days that arrived and the runs beside them, not the length of the series.

Dates and flags take next to no room in files, so a table of millions of days looks small enough to broadcast, and every task would
count it whole as its own memory. The joins ask for a merge instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import store

FIRST, LAST = "first_day", "last_day"


def runs_of(days: DataFrame, entity: str, day: str, flag: str) -> DataFrame:
    """entity, flag, first_day, last_day of the runs that the days form: one row per entity and day is expected."""
    in_order = Window.partitionBy(entity, flag).orderBy(day)
    anchored = days.select(entity, day, flag, F.date_sub(F.col(day), F.row_number().over(in_order)).alias("_run"))
    return anchored.groupBy(entity, flag, "_run").agg(F.min(day).alias(FIRST), F.max(day).alias(LAST)).select(entity, flag, FIRST, LAST)


def days_of(runs: DataFrame, entity: str, day: str, flag: str) -> DataFrame:
    """The days of the runs, with their run's length; a run has at most as many as the calendar."""
    length = F.datediff(LAST, FIRST) + 1
    return runs.select(entity, F.explode(F.sequence(FIRST, LAST)).alias(day), flag, length.alias("run_length_days"))


def touched(runs: DataFrame, days: DataFrame, entity: str, day: str) -> DataFrame:
    """The runs that hold one of the days or lie next to one.

    Each run is looked up by entity and year, in the years it reaches; a run over many years has as many rows there. The days
    are only asked for, never made distinct: that would keep a row for each of them in a task's memory. What is found is stored, and only
    runs that reach several years can be there more than once.
    """
    spans = runs.withColumn("_year", F.explode(F.sequence(F.year(F.date_sub(FIRST, 1)), F.year(F.date_add(LAST, 1)))))
    wanted = days.select(F.col(entity).alias("_entity"), F.year(day).alias("_in"), F.col(day).alias("_day"))
    beside = (F.col("_day") >= F.date_sub(FIRST, 1)) & (F.col("_day") <= F.date_add(LAST, 1))
    near = (F.col(entity) == F.col("_entity")) & (F.col("_year") == F.col("_in")) & beside
    found = store(spans.join(wanted.hint("merge"), near, "left_semi").drop("_year"), "touched")
    several = F.year(F.date_sub(FIRST, 1)) < F.year(F.date_add(LAST, 1))
    return found.where(~several).unionByName(found.where(several).distinct())


def advance(runs: DataFrame, days: DataFrame, entity: str, day: str, flag: str) -> tuple[DataFrame, DataFrame]:
    """Runs to take away and runs to put in their place when ``days`` arrive; a day that was there gets the new flag.

    ``days`` has one row per entity and day. Give stored tables, as each is read several times.
    """
    old = touched(runs, days, entity, day)
    kept = days_of(old, entity, day, flag).drop("run_length_days").join(days.select(entity, day).hint("merge"), [entity, day], "left_anti")
    return old, runs_of(kept.unionByName(days.select(entity, day, flag)), entity, day, flag)


def advanced(runs: DataFrame, days: DataFrame, entity: str, day: str, flag: str) -> DataFrame:
    """The whole table of runs after ``days`` have arrived."""
    old, new = advance(runs, days, entity, day, flag)
    # A run is known by its entity and first day: no two runs of an entity share a day.
    return runs.join(old.select(entity, FIRST).hint("merge"), [entity, FIRST], "left_anti").select(*new.columns).unionByName(new)
