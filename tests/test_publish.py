from __future__ import annotations

import datetime
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from seriesloom.plans import publish
from seriesloom.sources import tables
from tests.helpers import day

NOW = datetime.datetime(2024, 1, 2, 12, tzinfo=datetime.UTC)
EXPECTED = ("city_summary", "city_yearly")


def export(spark, folder, rows=3):
    exported = {
        "city_summary": spark.range(rows).withColumn("latest_date", F.lit(day("2024-01-01"))),
        "city_yearly": spark.range(0),
    }
    return publish.export_tables(spark, exported, folder, NOW)


def test_export_and_publish(spark, folder):
    manifest = {r.table_name: r for r in export(spark, f"{folder}/one").collect()}
    assert manifest["city_summary"].row_count == 3 and manifest["city_yearly"].row_count == 0
    assert manifest["city_summary"].byte_count == sum(
        len(open(p, "rb").read()) for p in glob.glob(f"{folder}/one/city_summary/*.parquet")
    )
    assert manifest["city_summary"].data_through == day("2024-01-01")
    publish.publish(spark, f"{folder}/one", f"{folder}/live", EXPECTED)
    export(spark, f"{folder}/two", 5)
    publish.publish(spark, f"{folder}/two", f"{folder}/live", EXPECTED)
    assert publish.live_table(spark, f"{folder}/live", "city_summary").count() == 5
    assert {r.status for r in publish.health(spark, f"{folder}/live").collect()} == {"ok"}


def test_small_tables_become_one_file(spark, folder):
    export(spark, folder)
    assert len(glob.glob(f"{folder}/city_summary/*.parquet")) == 1


def refused(spark, staging, live, expected=EXPECTED, match=""):
    with pytest.raises(publish.PublishRefused, match=match):
        publish.publish(spark, staging, live, expected)


def test_bad_exports_are_refused_and_nothing_changes(spark, folder):
    live = f"{folder}/live"
    with pytest.raises(FileNotFoundError):
        publish.live_folder(spark, live)
    export(spark, f"{folder}/good")
    publish.publish(spark, f"{folder}/good", live, EXPECTED)

    export(spark, f"{folder}/bad")
    refused(spark, f"{folder}/bad", live, (*EXPECTED, "model_skill"), "model_skill: not in the manifest")
    refused(spark, f"{folder}/bad", live, ("city_summary",), "city_yearly: unexpected table")

    spark.range(4).write.mode("overwrite").parquet(f"{folder}/bad/city_summary")
    refused(spark, f"{folder}/bad", live, EXPECTED, "city_summary: wrong row count")

    for path in glob.glob(f"{folder}/bad/city_summary/*.parquet"):
        open(path, "wb").write(b"this is not parquet")
        for crc in glob.glob(f"{folder}/bad/city_summary/.*.crc"):
            open(crc, "wb").write(b"")
    refused(spark, f"{folder}/bad", live, EXPECTED, "cannot be read")

    shutil.move(f"{folder}/bad/city_summary", f"{folder}/elsewhere")
    refused(spark, f"{folder}/bad", live, EXPECTED, "city_summary: not staged")
    refused(spark, f"{folder}/nothing", live, EXPECTED, "no complete manifest")
    assert publish.live_folder(spark, live) == f"{folder}/good"

    # A pointer left behind by a crash is not current, and does not block the next publication.
    os.makedirs(f"{live}/v=1")
    assert publish.live_folder(spark, live) == f"{folder}/good"
    export(spark, f"{folder}/better")
    publish.publish(spark, f"{folder}/better", live, EXPECTED)
    assert publish.live_folder(spark, live) == f"{folder}/better"


def test_changed_content_of_equal_length_is_refused(spark, folder):
    export(spark, f"{folder}/one")
    changed = spark.read.parquet(f"{folder}/one/city_summary").withColumn(
        "latest_date", F.when(F.col("id") == 2, F.lit(day("2024-01-02"))).otherwise(F.col("latest_date")))
    rows = changed.collect()
    spark.createDataFrame(rows, changed.schema).write.mode("overwrite").parquet(f"{folder}/one/city_summary")
    refused(spark, f"{folder}/one", f"{folder}/live", EXPECTED, "city_summary: changed content")
    # The same rows in other files and another order are the same content.
    export(spark, f"{folder}/two")
    same = spark.createDataFrame([(k, day("2024-01-01")) for k in (2, 0, 1)], changed.schema).repartition(3)
    same.write.mode("overwrite").parquet(f"{folder}/two/city_summary")
    publish.publish(spark, f"{folder}/two", f"{folder}/live", EXPECTED)


def test_fingerprints(spark):
    schema = "a string, b bigint, c double, d array<int>"
    rows = [("x", 1, 1.5, [1, None]), (None, 2, None, None), ("", None, 0.0, []), ("x", 1, 1.5, [1, None])]

    def of(values, schema=schema, parts=1):
        df = spark.createDataFrame(values, schema).repartition(parts)
        return df.agg(publish.fingerprint(df).alias("f")).first()[0]

    plain = of(rows)
    assert of(rows[::-1], parts=3) == plain
    others = [rows[:3], rows + rows[:1], [("x", 1, 1.5, [1]), *rows[1:]], [rows[0], ("", 2, None, None), *rows[2:]], [rows[0], (None, None, None, None), *rows[2:]], []]
    found = {of(v) for v in others}
    assert len(found) == len(others) and plain not in found
    assert of([], "a string") != of([], "a bigint") != of([], "b bigint")
    swapped = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    assert of([(2, 1)], "a bigint, b bigint") != swapped.agg(publish.fingerprint(swapped).alias("f")).first()[0]


def scanned_rows(df):
    """Rows that the file scan gave to the filter above it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(k).metrics().apply("numOutputRows").value()) for k in range(leaves.size()))


def test_bloom_filters_skip_row_groups(spark, folder):
    """An entity that lies between a row group's first and last one, but is not in it, costs no row."""
    table = spark.range(0, 4000, 2).withColumnRenamed("id", "location_id").withColumn("v", F.lit(1.0))
    publish.export_tables(spark, {"city_summary": table.withColumn("latest_date", F.lit(day("2024-01-01")))}, f"{folder}/one", NOW)
    table.coalesce(1).write.parquet(f"{folder}/plain")
    absent, present = F.col("location_id") == 1001, F.col("location_id") == 1000
    assert scanned_rows(spark.read.parquet(f"{folder}/plain").where(absent)) > 0
    exported = spark.read.parquet(f"{folder}/one/city_summary")
    assert scanned_rows(exported.where(absent)) == 0
    assert exported.where(present).count() == 1


def test_counts_and_bounds_come_from_the_footers(spark, folder):
    """With every data page overwritten the answers are the same, and the caller's settings are untouched."""
    days = spark.range(1000).selectExpr("id", "date_add(date'2024-01-01', cast(id % 90 as int)) as d", "cast(id as double) as x")
    days.repartition(3).write.option("compression", "none").parquet(f"{folder}/t")
    wanted = (F.count(F.lit(1)), F.max("d"), F.min("d"), F.max("x"))
    assert "PushedAggregation: [COUNT(*), MAX(d), MIN(d), MAX(x)]" in tables.from_footers(spark, f"{folder}/t", *wanted)._jdf.queryExecution().toString()
    for path in glob.glob(f"{folder}/t/*.parquet"):
        data = open(path, "rb").read()
        footer = int.from_bytes(data[-8:-4], "little")
        open(path, "wb").write(data[:4] + bytes(len(data) - footer - 12) + data[-footer - 8 :])
    for path in glob.glob(f"{folder}/t/.*.crc"):
        os.remove(path)
    assert tuple(tables.from_footers(spark, f"{folder}/t", *wanted).first()) == (1000, day("2024-03-30"), day("2024-01-01"), 999.0)
    with pytest.raises(Exception):
        spark.read.parquet(f"{folder}/t").agg(F.sum("x")).collect()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_newest_day_of_tables_without_days(spark, folder):
    spark.sql("select 1 as id, cast(null as date) as d").write.parquet(f"{folder}/none")
    spark.sql("select 1 as id, cast(null as date) as d").limit(0).write.parquet(f"{folder}/empty")
    assert publish.newest_day(spark, f"{folder}/none", "d") is None and publish.newest_day(spark, f"{folder}/empty", "d") is None
