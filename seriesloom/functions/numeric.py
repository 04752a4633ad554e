"""Column helpers for numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Round to ``digits`` places, ties away from zero.

    One rule for every size of value: a tie that binary noise has moved by less than 1e-9 of the last place
    counts as one. NULL, NaN and infinity stay as they are.
    """
    scale = F.lit(float(10**digits))
    return F.round(value * scale + F.signum(value) * 1e-9) / scale


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; NULL where the denominator is zero."""
    return top / F.nullif(bottom, F.lit(0.0))


def skill(error: Column, reference_error: Column) -> Column:
    """Share of the reference error that was removed."""
    return F.lit(1.0) - safe_ratio(error, reference_error)


def clamp_scale(value: Column, limit: float) -> Column:
    """Scale to [-1, 1], with anything at or past the limit at the end of the scale."""
    scaled = value / F.lit(float(limit))
    usable = value.isNotNull() & ~F.isnan(value)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled)))


def ordered(names: Iterable[str]) -> list[Column]:
    """The named columns with their values put in ascending order, row by row."""
    names = list(names)
    values = F.array_sort(F.array(*[F.col(n) for n in names]))
    return [values[i].alias(n) for i, n in enumerate(names)]


def inside(value: Column, low: Column, high: Column) -> Column:
    """1.0 when the value lies in the closed interval, else 0.0; averaging gives the coverage."""
    return value.between(low, high).cast("double")
