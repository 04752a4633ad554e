"""Windows over daily series: runs of flagged days, and frames around a day.

A series has at most one row per entity and day (the silver merge and the uniqueness test see to
it), so a window over one entity holds at most one row per calendar day, however large the whole
table is. The plain forms below rest on that bound and cost one shuffle by entity, which all
windows over the entity share.

For a few very long series even that is too much for one task. The ``split`` forms cut each series
into blocks of at most one year, which may lie in different tasks, and give the same rows. They read
their input twice (once for row counts per block), so it should be a stored table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

RUN_LENGTH = "run_length_days"


def largest_series(df: DataFrame, entity: str) -> int:
    """Rows of the longest series; reads only the entity column."""
    return df.groupBy(entity).count().agg(F.max("count")).first()[0] or 0


# -- runs


def run_lengths(df: DataFrame, entity: str, day: str, flag: str) -> DataFrame:
    """Add the length of the unbroken run of days with an equal flag that each row belongs to.

    A missing day ends a run. Within one (entity, flag), days of one run share the difference
    between the date and the running row number.
    """
    in_order = Window.partitionBy(entity, flag).orderBy(day)
    anchored = df.withColumn("_run", F.date_sub(F.col(day), F.row_number().over(in_order)))
    same_run = Window.partitionBy(entity, flag, "_run")
    return anchored.withColumn(RUN_LENGTH, F.count(F.lit(1)).over(same_run)).drop("_run")


def run_lengths_split(df: DataFrame, entity: str, day: str, flag: str) -> DataFrame:
    """As :func:`run_lengths`, with no window over more than one year of one entity's days.

    Runs are found inside each year. Only a run that reaches a year's first or last day can go on
    in the next year; those few (at most two per year and flag) are chained per entity as intervals.
    """
    block = ["_block", entity, flag]
    # The explicit shuffle keeps years apart even where the input lies together by entity.
    rows = df.withColumn("_block", F.year(day)).repartition(entity, "_block")
    in_order = Window.partitionBy(*block).orderBy(day)
    rows = rows.withColumn("_run", F.date_sub(F.col(day), F.row_number().over(in_order)))
    local = rows.groupBy(*block, "_run").agg(
        F.min(day).alias("_first"), F.max(day).alias("_last"), F.count(F.lit(1)).alias("_days")
    )
    starts_year = F.dayofyear("_first") == 1
    ends_year = (F.month("_last") == 12) & (F.dayofmonth("_last") == 31)
    edge = local.where(starts_year | ends_year)
    by_time = Window.partitionBy(entity, flag).orderBy("_first")
    breaks = F.coalesce(F.datediff("_first", F.lag("_last").over(by_time)) != 1, F.lit(True))
    chain = edge.withColumn("_chain", F.sum(breaks.cast("int")).over(by_time))
    whole = chain.select(
        *block, "_run", F.sum("_days").over(Window.partitionBy(entity, flag, "_chain")).alias("_chained")
    )
    local_length = F.count(F.lit(1)).over(Window.partitionBy(*block, "_run"))
    counted = rows.withColumn("_local", local_length).join(whole, [*block, "_run"], "left")
    length = F.coalesce("_chained", "_local").alias(RUN_LENGTH)
    return counted.select(*df.columns, length)


# -- frames


def by_day(entity: str, day: str):
    return Window.partitionBy(entity).orderBy(day)


def window_columns(
    df: DataFrame, entity: str, day: str, make: Callable[[WindowSpec], list[Column]], back: int, ahead: int,
    split: bool = False, block_rows: int = 366,
) -> DataFrame:
    """Add the columns that ``make(window)`` builds over ``entity`` in the order of ``day``.

    ``back`` and ``ahead`` say how many rows before and after a row the columns may look at. Frames
    count rows, not days, so they step over missing days.
    """
    if not split:
        return df.select("*", *make(by_day(entity, day)))
    blocks = _with_halo(df, entity, day, back, ahead, max(block_rows, back, ahead))
    window = Window.partitionBy(entity, "_block").orderBy("_row")
    added = make(window)
    return blocks.select("*", *added).where("_own").drop("_own", "_block", "_row")


def _with_halo(df: DataFrame, entity: str, day: str, back: int, ahead: int, size: int) -> DataFrame:
    """Cut each series into blocks of ``size`` rows, each with copies of its neighbours' nearest rows.

    Row numbers within the series are exact without ordering the series in one task: they are the
    number within the year plus the rows of the years before.
    """
    # The explicit shuffle keeps years apart even where the input lies together by entity.
    rows = df.withColumn("_year", F.year(day)).repartition(entity, "_year")
    per_year = df.groupBy(entity, F.year(day).alias("_year")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(entity).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_year.select(entity, "_year", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(entity, "_year").orderBy(day)
    numbered = (
        rows.withColumn("_row", F.row_number().over(within))
        .join(offsets, [entity, "_year"])
        .withColumn("_row", F.col("_row") + F.col("_before") - 1)
        .drop("_before", "_year")
    )
    own = F.floor(F.col("_row") / size)
    # A row belongs to the block it is in and to those whose nearest rows reach it.
    first = F.floor((F.col("_row") - ahead) / size)
    last = F.floor((F.col("_row") + back) / size)
    spread = numbered.withColumn("_home", own).withColumn("_block", F.explode(F.sequence(first, last)))
    return spread.withColumn("_own", F.col("_block") == F.col("_home")).drop("_home")


def centred_mean(column: str, window, rows: int) -> Column:
    """Mean of the row, ``rows`` before and ``rows`` after, as far as they exist."""
    return F.avg(column).over(window.rowsBetween(-rows, rows))


def trailing(function: Column, window, rows: int) -> Column:
    """An aggregate over the row and the ``rows - 1`` before it."""
    return function.over(window.rowsBetween(-(rows - 1), 0))


def full_moving_mean(column: str, window, rows: int) -> Column:
    """Trailing mean that is NULL until ``rows`` rows exist."""
    return F.when(F.row_number().over(window) >= rows, trailing(F.avg(column), window, rows))


def last_rows(df: DataFrame, entity: str, day: str, count: int) -> DataFrame:
    """The newest ``count`` rows of each entity."""
    newest_first = Window.partitionBy(entity).orderBy(F.col(day).desc())
    return df.withColumn("_n", F.row_number().over(newest_first)).where(F.col("_n") <= count).drop("_n")


def newest_row(df: DataFrame, entity: str, day: str) -> DataFrame:
    """The newest row of each entity, as an aggregate: one candidate per entity leaves each task."""
    rest = [c for c in df.columns if c != entity]
    newest = F.max_by(F.struct(*rest), F.col(day)).alias("_newest")
    return df.groupBy(entity).agg(newest).select(*[
        F.col(c) if c == entity else F.col(f"_newest.{c}").alias(c) for c in df.columns
    ])


def within_days(day: Column, latest: Column, days: int) -> Column:
    """Whether a date is one of the ``days`` dates that end at ``latest``."""
    return day > F.date_sub(latest, days)

