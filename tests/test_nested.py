from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import nested
from seriesloom.streaming import silver
from tests.helpers import day, tuples


def raw(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("raw"))


REPLY = """{"location_id": 1, "extracted_at": "20240101T000000Z", "payload": {"daily": {
  "time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [5.0, 6.0], "temperature_2m_min": [1.0],
  "temperature_2m_mean": [3, null], "precipitation_sum": [0.0, 0.0]%s}}}"""
GUSTS = ', "wind_gusts_10m_max": [30.0, 40.0]'


def test_short_arrays_are_padded(spark):
    rows = tuples(silver.weather_rows(raw(spark, REPLY % GUSTS)), "weather_date")
    assert rows == [
        (1, day("2024-01-01"), 5.0, 1.0, 3.0, 0.0, 30.0, "20240101T000000Z"),
        (1, day("2024-01-02"), 6.0, None, None, 0.0, 40.0, "20240101T000000Z"),
    ]


def test_a_missing_array_gives_no_rows_and_is_counted(spark):
    replies = raw(spark, REPLY % "", REPLY % GUSTS)
    assert silver.weather_rows(replies).count() == 2
    assert tuples(silver.reply_metrics(replies)) == [(2, 1)]
    filled = silver.weather_rows(replies, fill_missing=True)
    assert filled.count() == 4
    assert filled.where("wind_gust_max_kmh is null").count() == 2


def test_strict_and_tolerant_reads(spark):
    rows = raw(spark, '{"k": 1}', '{"k": "x"}', '{}')
    fields = {"k": ("$.k", "bigint")}
    found = tuples(rows.select(*nested.variant_fields(fields, tolerant=True)))
    assert sorted(found, key=str) == [(1,), (None,), (None,)]
    with pytest.raises(Exception, match="INVALID_VARIANT_CAST"):
        rows.select(*nested.variant_fields(fields)).collect()
