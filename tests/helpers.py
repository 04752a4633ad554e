from __future__ import annotations

import datetime

from seriesloom.schemas import columns

DAILY = columns(
    "location_id BIGINT, weather_date DATE, temperature_max_c DOUBLE, temperature_min_c DOUBLE, "
    "temperature_mean_c DOUBLE, precipitation_mm DOUBLE, wind_gust_max_kmh DOUBLE, extracted_at STRING"
)


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def days(first: str, count: int) -> list[datetime.date]:
    start = day(first)
    return [start + datetime.timedelta(days=i) for i in range(count)]


def weather(spark, rows):
    """Rows of (place, day, mean[, max]) as a daily table."""
    full = []
    for row in rows:
        place, date, mean = row[:3]
        top = row[3] if len(row) > 3 else mean + 5
        full.append((place, date, top, mean - 5, mean, 1.0, 20.0, "20240101T000000Z"))
    return spark.createDataFrame(full, DAILY)


def tuples(df, *order):
    rows = df.orderBy(*order) if order else df
    return [tuple(r) for r in rows.collect()]
