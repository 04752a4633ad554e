"""Bands derived from a position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits (exclusive) of the absolute latitude.
TROPICS = 23.5
POLAR_CIRCLE = 66.5


def hemisphere(latitude: Column) -> Column:
    """An unknown latitude counts as southern."""
    return F.when(latitude >= 0, "Northern").otherwise("Southern")


def latitude_band(latitude: Column) -> Column:
    """An unknown latitude counts as polar."""
    distance = F.abs(latitude)
    return F.when(distance < TROPICS, "Tropical").when(distance < POLAR_CIRCLE, "Temperate").otherwise("Polar")
