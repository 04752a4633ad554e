"""Differences in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below these sizes a difference is not worth a number.
DAY_THRESHOLD = 0.2
YEAR_THRESHOLD = 0.05


def one_decimal(size: Column) -> Column:
    """A non-negative double as text with one decimal, rounded by its exact binary value, ties up.

    ``%.1f`` would round the shortest decimal that prints the double instead, and so turn 1.45, which
    lies just below the tie, into 1.5. With t the tenths, 20 * size is compared with 2t + 1; taken as
    16 + 4 times the size, both differences are exact near the tie.
    """
    tenths = F.floor(size * 10)
    past_half = (size * 16 - (tenths * 2 + 1)) + size * 4 >= 0
    rounded = tenths + past_half.cast("bigint")
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def _in_words(value: Column, threshold: float, small: str, reference: str) -> Column:
    size = F.abs(value)
    amount = one_decimal(size)
    direction = F.when(value > 0, F.lit("warmer")).otherwise(F.lit("colder"))
    worded = F.concat(amount, F.lit(" °C "), direction, F.lit(f" than {reference}"))
    return F.when(size < threshold, F.lit(small)).when(value.isNotNull(), worded)


def describe_anomaly(value: Column) -> Column:
    return _in_words(value, DAY_THRESHOLD, "close to normal", "usual")


def describe_vs_average(value: Column, first_year: int = 1961, last_year: int = 1990) -> Column:
    period = f"the {first_year} to {last_year} average"
    return _in_words(value, YEAR_THRESHOLD, f"the same as {period}", period)
