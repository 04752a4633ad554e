"""Column helpers for dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STAMP_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
LAST_DAY_OF_YEAR = 365
DAYS_PER_YEAR = 365.25


def date_key(day: Column) -> Column:
    """A date as the integer yyyyMMdd, from its parts: cheaper than formatting text."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def folded_day(day: Column) -> Column:
    """Day of the year with day 366 counted as day 365."""
    return F.least(F.dayofyear(day), F.lit(LAST_DAY_OF_YEAR)).cast("int")


def season(day: Column) -> Column:
    """Meteorological season: the three-month block the month falls in, December first."""
    names = F.array(*[F.lit(s) for s in ("DJF", "MAM", "JJA", "SON")])
    return F.element_at(names, (F.floor((F.month(day) % 12) / 3) + 1).cast("int"))


def decade(day: Column) -> Column:
    return (F.year(day) - F.pmod(F.year(day), F.lit(10))).cast("int")


def cycle(day_of_year: Column) -> tuple[Column, Column]:
    """Sine and cosine of the position in the year."""
    angle = day_of_year * F.lit(2 * math.pi) / F.lit(DAYS_PER_YEAR)
    return F.sin(angle), F.cos(angle)


def stamp(moment: Column) -> Column:
    """A timestamp as compact text whose text order is its time order."""
    return F.date_format(moment, STAMP_FORMAT)


def in_years(day: Column, first: int, last: int) -> Column:
    """``year(day) between first and last``, as a date range the Parquet reader can skip by."""
    return day.between(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31)))
