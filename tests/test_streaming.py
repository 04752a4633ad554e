from __future__ import annotations

import itertools
import json
import os
import time

import pytest

from seriesloom.sources import tables
from seriesloom.streaming import bronze, silver
from tests.helpers import day, tuples

NAMES = ["temperature_2m_max", "temperature_2m_min", "temperature_2m_mean", "precipitation_sum", "wind_gusts_10m_max"]


def reply(place, stamp, daily):
    """``daily`` is a list of (day, max, min, mean, rain, gust)."""
    columns = list(zip(*daily, strict=True))
    body = {"time": list(columns[0]), **dict(zip(NAMES, map(list, columns[1:]), strict=True))}
    return {"location_id": place, "extracted_at": stamp, "payload": {"daily": body}}


A = reply(1, "20240110T000000Z", [("2024-01-01", 5.0, 1.0, 3.0, 0.0, 20.0), ("2024-01-02", 6.0, 2.0, 4.0, 0.0, 20.0)])
B = reply(1, "20240111T000000Z", [("2024-01-02", 7.0, 2.0, 5.0, 1.0, 30.0), ("2024-01-03", -95.0, 9.0, 4.0, -1.0, 20.0)])
# Newer, but the mean of 2 January is missing: the older complete day stays.
C = reply(1, "20240112T000000Z", [("2024-01-02", 9.0, 9.0, None, 9.0, 90.0), ("2024-02-01", 6.0, 1.0, 2.0, 0.0, 10.0)])

EXPECTED = [
    (1, day("2024-01-01"), 5.0, 1.0, 3.0, 0.0, 20.0, "20240110T000000Z"),
    (1, day("2024-01-02"), 7.0, 2.0, 5.0, 1.0, 30.0, "20240111T000000Z"),
    (1, day("2024-01-03"), -95.0, 9.0, 4.0, -1.0, 20.0, "20240111T000000Z"),
    (1, day("2024-02-01"), 6.0, 1.0, 2.0, 0.0, 10.0, "20240112T000000Z"),
]


def put(folder, name, record):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
        json.dump(record, f)


def refresh(spark, base, metrics=None):
    bronze.load_raw(spark, f"{base}/landing", f"{base}/raw", f"{base}/raw_cp").awaitTermination()
    keep = metrics.append if metrics is not None else None
    silver.refresh_weather(
        spark, f"{base}/raw", f"{base}/silver", f"{base}/silver_cp",
        on_metrics=(lambda query, batch, counts: keep(counts)) if keep else None,
    ).awaitTermination()


def result(spark, base):
    return tuples(silver.weather_table(spark, f"{base}/silver").read().drop(silver.SOURCE), "weather_date")


def test_result_does_not_depend_on_the_order_of_files(spark, folder):
    for n, order in enumerate(itertools.permutations([A, B, C])):
        if n not in (0, 3, 5):
            continue
        base = f"{folder}/{n}"
        for i, record in enumerate(order):
            put(f"{base}/landing", f"{i}", record)
            refresh(spark, base)
        assert result(spark, base) == EXPECTED


def test_files_are_taken_once_and_metrics_are_counted(spark, folder):
    for i, record in enumerate((A, B, C)):
        put(f"{folder}/landing", f"{i}", record)
    metrics = []
    refresh(spark, folder, metrics)
    refresh(spark, folder, metrics)
    assert spark.read.parquet(f"{folder}/raw").count() == 3
    assert len(metrics) == 1
    assert metrics[0] == {
        "row_count": 6, "dropped_valid_key": 0, "dropped_complete_day": 1, "plausible_temperature": 1,
        "min_not_above_max": 1, "non_negative_precipitation": 1, "replies": 3, "replies_without_rows": 0,
    }
    assert result(spark, folder) == EXPECTED


def test_counts_lost_in_a_crash_are_counted_again(spark, folder):
    """The table had committed the batch, but its counts were not kept."""
    for i, record in enumerate((A, B, C)):
        put(f"{folder}/landing", f"{i}", record)

    class Failing(list):
        def append(self, counts):
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        refresh(spark, folder, Failing())
    assert result(spark, folder) == EXPECTED
    metrics = []
    refresh(spark, folder, metrics)
    assert [(m["row_count"], m["dropped_complete_day"], m["replies"]) for m in metrics] == [(6, 1, 3)]
    assert result(spark, folder) == EXPECTED


def test_expectations_are_counted_while_the_batch_is_stored(spark, folder, monkeypatch):
    """Nothing but the merge reads the batch: neither a second aggregate over it nor a cached copy."""
    for i, record in enumerate((A, B)):
        put(f"{folder}/landing", f"{i}", record)
    read = []
    rows = silver.weather_rows
    monkeypatch.setattr(silver, "weather_rows", lambda raw, *a: read.append(1) or rows(raw, *a))
    metrics = []
    refresh(spark, folder, metrics)
    assert len(read) == 1 and metrics[0]["row_count"] == 4
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_replies_are_unpacked_once(spark, folder, monkeypatch):
    """What counts the replies takes the arrays that become rows; a count of raw values would unpack each of them again."""
    for i, record in enumerate((A, B)):
        put(f"{folder}/landing", f"{i}", record)
    seen = []
    observe = type(spark.range(1)).observe
    monkeypatch.setattr(type(spark.range(1)), "observe", lambda df, name, *columns: seen.append((df, columns)) or observe(df, name, *columns))
    metrics = []
    refresh(spark, folder, metrics)
    counted = [(df, [str(c) for c in columns]) for df, columns in seen]
    assert len(counted) == 2 and not any("variant_get" in c for _, columns in counted for c in columns)
    assert "raw" not in counted[0][0].columns
    assert (metrics[0]["replies"], metrics[0]["replies_without_rows"], metrics[0]["row_count"]) == (2, 0, 4)


def test_a_reply_without_rows_is_counted_in_passing(spark, folder):
    short = reply(2, "20240110T000000Z", [("2024-01-01", 5.0, 1.0, 3.0, 0.0, 20.0)])
    del short["payload"]["daily"]["wind_gusts_10m_max"]
    for i, record in enumerate((A, short)):
        put(f"{folder}/landing", f"{i}", record)
    metrics = []
    refresh(spark, folder, metrics)
    assert (metrics[0]["replies"], metrics[0]["replies_without_rows"], metrics[0]["row_count"]) == (2, 1, 2)


def test_the_first_batch_is_reduced_once(spark, folder, monkeypatch):
    """An empty table takes a batch with one row per key as it is; later ones meet its rows in an aggregate."""
    calls = []
    latest = tables.keep_latest
    monkeypatch.setattr(tables, "keep_latest", lambda *a: calls.append(1) or latest(*a))
    for n, (record, aggregates) in enumerate(((B, 0), (A, 1), (C, 2))):
        put(f"{folder}/landing", f"{n}", record)
        refresh(spark, folder)
        assert len(calls) == aggregates
    assert result(spark, folder) == EXPECTED
    # Without the promise of one row per key the first batch is reduced too.
    rows = silver.weather_table(spark, f"{folder}/silver").read()
    other = silver.weather_table(spark, f"{folder}/other")
    older = rows.withColumn("extracted_at", rows.extracted_at.substr(1, 4))
    other.upsert_latest(older.unionByName(rows), ("location_id", "weather_date"), ("extracted_at", silver.SOURCE))
    assert tuples(other.read().drop(silver.SOURCE), "weather_date") == EXPECTED


def test_equal_sequences_are_decided_by_the_source_file(spark, folder):
    first = reply(1, "20240110T000000Z", [("2024-01-01", 5.0, 1.0, 1.0, 0.0, 20.0)])
    second = reply(1, "20240110T000000Z", [("2024-01-01", 5.0, 1.0, 2.0, 0.0, 20.0)])
    for n, order in enumerate((("a", "b"), ("b", "a"))):
        for name in order:
            put(f"{folder}/{n}/landing", name, first if name == "a" else second)
            refresh(spark, f"{folder}/{n}")
        assert [r[4] for r in result(spark, f"{folder}/{n}")] == [2.0]


def test_locations_keep_the_latest_file_and_drop_bad_positions(spark, folder):
    def place(number, latitude, population=None):
        return {"id": number, "name": f"n{number}", "country_code": "XX", "latitude": latitude, "longitude": 5,
                **({"population": population} if population else {})}

    def load():
        bronze.load_raw(spark, f"{folder}/landing", f"{folder}/raw", f"{folder}/raw_cp").awaitTermination()
        silver.refresh_locations(spark, f"{folder}/raw", f"{folder}/silver", f"{folder}/cp").awaitTermination()

    for record in (place(1, 10.5), place(2, 91), place(3, None)):
        put(f"{folder}/landing", f"first{record['id']}", record)
    load()
    time.sleep(0.05)
    put(f"{folder}/landing", "later", place(1, 11, 1000))
    load()
    found = silver.location_table(spark, f"{folder}/silver").read()
    assert tuples(found.select("location_id", "latitude", "population", "region")) == [(1, 11.0, 1000, None)]
