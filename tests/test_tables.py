from __future__ import annotations

import glob
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.operators.latest import keep_latest, replace_matching
from seriesloom.sources import landing, tables
from seriesloom.sources.tables import VersionedTable
from tests.helpers import tuples

SCHEMA = schemas.columns("k BIGINT, part_of BIGINT, seq BIGINT, v STRING")


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def table(spark, folder):
    return VersionedTable(spark, f"{folder}/t", SCHEMA, F.col("part_of"))


def test_latest_keeps_the_highest_sequence(spark):
    df = rows(spark, (1, 0, 5, "new"), (1, 0, 4, "old"), (2, 0, 1, "only"))
    assert tuples(keep_latest(df, ["k"], ["seq"]), "k") == [(1, 0, 5, "new"), (2, 0, 1, "only")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.text("ab", max_size=2)), min_size=1, max_size=30))
def test_latest_matches_brute_force(spark, values):
    df = rows(spark, *[(k, 0, s, v) for k, s, v in values])
    expected = {}
    for k, s, v in values:
        expected[k] = max(expected.get(k, (s, v)), (s, v))
    assert tuples(keep_latest(df, ["k"], ["seq", "v"]), "k") == [(k, 0, *expected[k]) for k in sorted(expected)]


def test_replace_matching(spark):
    old, new = rows(spark, (1, 0, 9, "a"), (2, 0, 9, "b")), rows(spark, (2, 0, 1, "c"), (3, 0, 1, "d"))
    assert [r[3] for r in tuples(replace_matching(old, new, ["k"]), "k")] == ["a", "c", "d"]


def test_upserts_by_sequence_do_not_depend_on_order(spark, folder):
    batches = [
        rows(spark, (1, 0, 1, "a1"), (2, 1, 3, "b3")),
        rows(spark, (1, 0, 2, "a2"), (3, 1, 1, "c1")),
        rows(spark, (2, 1, 2, "b2"), (1, 0, 0, "a0")),
    ]
    results = []
    for n, order in enumerate(((0, 1, 2), (2, 1, 0), (1, 0, 2))):
        target = table(spark, f"{folder}/{n}")
        for i in order:
            target.upsert_latest(batches[i], ["k"], ["seq"])
        results.append(tuples(target.read(), "k"))
    assert results[0] == results[1] == results[2] == [(1, 0, 2, "a2"), (2, 1, 3, "b3"), (3, 1, 1, "c1")]


def loads(target, version):
    return {r.part_key: r.load for r in target.parts(version).collect()}


def test_only_touched_parts_are_rewritten(spark, folder):
    target = table(spark, folder)
    target.upsert(rows(spark, (1, 0, 1, "a"), (2, 1, 1, "b")), ["k"])
    target.upsert(rows(spark, (2, 1, 1, "c")), ["k"])
    old, new = loads(target, 0), loads(target, 1)
    assert old["x30"] == new["x30"] and old["x31"] != new["x31"]
    assert [n for n in os.listdir(f"{folder}/t/data/load={new['x31']}") if n.startswith("part")] == ["part_key=x31"]
    assert [r[3] for r in tuples(target.read(), "k")] == ["a", "c"]


def test_reading_skips_replaced_parts(spark, folder):
    target = table(spark, folder)
    target.upsert(rows(spark, *[(k, k, 1, "a") for k in range(12)]), ["k"])
    for n in range(5):
        target.upsert(rows(spark, (1, 1, 1, f"b{n}"), (2, 2, 1, f"b{n}")), ["k"])
    plan = target.read()._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert target.read().count() == 12 and len(glob.glob(f"{folder}/t/data/*/*/*.parquet")) == 22


def test_many_parts_stay_in_tables(spark, folder, monkeypatch):
    """No name of a part reaches the driver: neither folder listings nor collected rows of them."""
    target = table(spark, folder)
    wide = spark.range(3000).selectExpr("id as k", "id as part_of", "1L as seq", "'a' as v")
    listed = []
    monkeypatch.setattr(tables, "child_names", lambda spark, path, real=tables.child_names: listed.append(path) or real(spark, path))
    target.upsert(wide, ["k"])
    target.upsert(wide.where("k in (5, 2900)").withColumn("v", F.lit("b")), ["k"])
    assert target.parts(1).count() == 3000 and target.parts(1).select("load").distinct().count() == 2
    assert {p.rsplit("/", 1)[1] for p in listed} == {"versions"}
    assert target.read().where("v = 'b'").count() == 2 and target.read().count() == 3000


def test_null_and_escaped_parts_are_merged(spark, folder):
    target = VersionedTable(spark, f"{folder}/t", SCHEMA, F.col("v"))
    target.upsert(rows(spark, (1, 0, 1, None), (2, 0, 1, "a:b"), (3, 0, 1, "a/b=%3A"), (4, 0, 1, "null"), (5, 0, 1, "")), ["k"])
    target.upsert(rows(spark, (6, 0, 1, None), (7, 0, 1, "a:b"), (8, 0, 1, "a/b=%3A"), (9, 0, 1, "null"), (10, 0, 1, "")), ["k"])
    assert [r[0] for r in tuples(target.read(), "k")] == list(range(1, 11))


def test_a_replayed_batch_is_skipped(spark, folder):
    target = table(spark, folder)
    target.upsert_latest(rows(spark, (1, 0, 1, "a")), ["k"], ["seq"], source=("q", 0))
    for _ in range(2):
        target.upsert_latest(rows(spark, (1, 0, 2, "b"), (2, 0, 1, "c")), ["k"], ["seq"], source=("q", 1))
    assert target.versions() == [0, 1]
    assert tuples(target.read(), "k") == [(1, 0, 2, "b"), (2, 0, 1, "c")]


def test_a_new_checkpoint_keeps_the_rows(spark, folder):
    target = table(spark, folder)
    target.upsert_latest(rows(spark, (1, 0, 1, "a")), ["k"], ["seq"], source=("first", 0))
    target.upsert_latest(rows(spark, (3, 0, 1, "c")), ["k"], ["seq"], source=("second", 0))
    assert [r[0] for r in tuples(target.read(), "k")] == [1, 3]


def test_two_rows_of_a_key_are_refused(spark, folder):
    target = table(spark, folder)
    with pytest.raises(tables.DuplicateKeys):
        target.upsert(rows(spark, (1, 0, 1, "a"), (1, 0, 2, "b")), ["k"])
    assert not target.exists()


def test_a_second_writer_is_refused(spark, folder, monkeypatch):
    target, other = table(spark, folder), table(spark, folder)
    target.upsert(rows(spark, (1, 0, 1, "a")), ["k"])
    write = target._write

    def slow(df):
        other.upsert(rows(spark, (2, 0, 1, "b")), ["k"])
        return write(df)

    monkeypatch.setattr(target, "_write", slow)
    with pytest.raises(tables.ConcurrentWrite):
        target.upsert(rows(spark, (3, 0, 1, "c")), ["k"])
    assert [r[0] for r in tuples(other.read(), "k")] == [1, 2]
    monkeypatch.undo()
    target.upsert(rows(spark, (3, 0, 1, "c")), ["k"])
    assert [r[0] for r in tuples(other.read(), "k")] == [1, 2, 3]


def test_of_writers_that_finish_together_one_wins(spark, folder, monkeypatch):
    """All are held between writing their rows and claiming the version."""
    table(spark, folder).upsert(rows(spark, (0, 0, 1, "first")), ["k"])
    barrier = threading.Barrier(4)
    claim = tables.create_exclusively
    monkeypatch.setattr(tables, "create_exclusively", lambda *a: barrier.wait(60) >= 0 and claim(*a))

    def write(k):
        try:
            table(spark, folder).upsert(rows(spark, (k, k % 2, 1, f"w{k}")), ["k"])
            return k
        except tables.ConcurrentWrite:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = [k for k in pool.map(write, range(1, 5)) if k]
    monkeypatch.undo()
    assert len(done) == 1
    assert [r[0] for r in tuples(table(spark, folder).read(), "k")] == [0, *done]
    for k in range(1, 5):
        table(spark, folder).upsert(rows(spark, (k, k % 2, 1, f"w{k}")), ["k"])
    assert [r[0] for r in tuples(table(spark, folder).read(), "k")] == [0, 1, 2, 3, 4]


def test_an_exclusive_file_has_one_creator(spark, folder):
    with ThreadPoolExecutor(16) as pool:
        for n in range(20):
            made = list(pool.map(lambda _, n=n: tables.create_exclusively(spark, f"{folder}/claims/v={n}"), range(16)))
            assert sum(made) == 1


def test_a_claim_without_a_version_needs_a_takeover(spark, folder):
    target = table(spark, folder)
    target.upsert(rows(spark, (1, 0, 1, "a")), ["k"])
    target._write(rows(spark, (1, 0, 1, "broken")).withColumn("part_key", F.lit("x30")))
    assert tables.create_exclusively(spark, f"{folder}/t/claims/v=1")
    assert tuples(target.read()) == [(1, 0, 1, "a")]
    with pytest.raises(tables.ConcurrentWrite):
        target.upsert(rows(spark, (2, 0, 1, "b")), ["k"])
    target.release(1)
    target.upsert(rows(spark, (2, 0, 1, "b")), ["k"])
    assert target.versions() == [0, 1] and [r[0] for r in tuples(target.read(), "k")] == [1, 2]
    with pytest.raises(ValueError):
        target.release(1)


def test_high_water_mark_comes_from_the_commit(spark, folder):
    target = VersionedTable(spark, f"{folder}/t", SCHEMA, F.col("part_of"), tracked=["v"])
    assert tables.newer_than_target(rows(spark, (1, 0, 1, "a")), target, "v").count() == 1
    target.upsert(rows(spark, (1, 0, 1, "c"), (2, 1, 1, "b")), ["k"])
    target.upsert(rows(spark, (3, 1, 1, "a")), ["k"])
    assert target.high_water("v") == "c"
    assert [r[3] for r in tuples(tables.newer_than_target(rows(spark, (1, 0, 1, "b"), (2, 0, 1, "d")), target, "v"))] == ["d"]
    with pytest.raises(ValueError):
        target.high_water("seq")


def test_expired_versions_are_removed(spark, folder):
    target = table(spark, folder)
    for k in range(4):
        target.upsert(rows(spark, (k % 2, k % 2, k, f"v{k}")), ["k"])
    assert target.expire(keep=1) == [0, 1, 2] and len(os.listdir(f"{folder}/t/data")) == 2
    assert [r[3] for r in tuples(target.read(), "k")] == ["v2", "v3"] and target.versions() == [3]
    target.upsert(rows(spark, (5, 0, 1, "w")), ["k"])
    assert target.versions() == [3, 4]


def test_a_backfill_rewrites_its_own_parts_only(spark, folder):
    schema = schemas.columns("location_id BIGINT, weather_date DATE, x INT")
    target = VersionedTable(spark, f"{folder}/t", schema, tables.place_year(8))
    days = spark.sql("select explode(sequence(date'2000-01-01', date'2004-12-31', interval 10 days)) as weather_date")
    places = spark.range(40).withColumnRenamed("id", "location_id")
    target.upsert(places.crossJoin(days).withColumn("x", F.lit(1)), ["location_id", "weather_date"])
    first = loads(target, 0)
    assert len(first) == 8 * 5
    target.upsert(places.where("location_id = 3").crossJoin(days).withColumn("x", F.lit(2)), ["location_id", "weather_date"])
    second = loads(target, 1)
    assert sum(second[p] != first[p] for p in first) == 5
    target.upsert(places.crossJoin(days.where("year(weather_date) = 2004")).withColumn("x", F.lit(3)), ["location_id", "weather_date"])
    third = loads(target, 2)
    assert sum(third[p] != second[p] for p in first) == 8


def test_an_empty_batch_changes_nothing(spark, folder):
    target = table(spark, folder)
    target.upsert(rows(spark, (1, 0, 1, "a")), ["k"])
    target.upsert(rows(spark, (1, 0, 1, "a")).limit(0), ["k"])
    assert tuples(target.read()) == [(1, 0, 1, "a")]
    empty = table(spark, f"{folder}/none")
    empty.upsert(rows(spark, (1, 0, 1, "a")).limit(0), ["k"], source=("q", 3))
    assert empty.read().collect() == [] and empty.versions() == [0]
    empty.overwrite(rows(spark, (1, 0, 1, "a")).limit(0))
    assert empty.read().collect() == [] and empty.versions() == [0, 1]


def test_high_water_mark(spark):
    source = rows(spark, (1, 0, 1, "a"), (2, 0, 2, "b"), (3, 0, 3, "c"))
    newer = tables.newer_than_target(source, source.where("seq = 2"), "seq")
    assert [r[0] for r in tuples(newer)] == [3]
    assert tables.newer_than_target(source, tables.empty_like(source), "seq").count() == 3


def test_overwrite_may_change_the_columns(spark, folder):
    target = VersionedTable(spark, f"{folder}/t", SCHEMA)
    target.overwrite(rows(spark, (1, 0, 1, "a")))
    target.overwrite(rows(spark, (1, 0, 1, "a")).withColumn("w", F.lit(2.0)))
    assert target.read().columns == ["k", "part_of", "seq", "v", "w"]


def test_clustered_files_are_sorted(spark, folder):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    tables.clustered(df, "k", "v").write.parquet(f"{folder}/c")
    for path in glob.glob(f"{folder}/c/*.parquet"):
        found = [tuple(r) for r in spark.read.parquet(path).collect()]
        assert found == sorted(found)
    assert spark.read.parquet(f"{folder}/c").count() == 1000


def test_schema_check(spark):
    df = rows(spark, (1, 0, 1, "a"))
    assert schemas.check_schema(df, SCHEMA) is df
    for wrong in (df.drop("v"), df.withColumn("k", F.lit("x")), df.withColumn("z", F.lit(1))):
        with pytest.raises(schemas.SchemaMismatch):
            schemas.check_schema(wrong, SCHEMA)


def test_snapshots_and_entity_list(spark, folder):
    df = spark.createDataFrame([("São Paulo", "BR"), ("Berlin", "DE")], "city string, country_code string")
    landing.land_snapshot(df.limit(1), f"{folder}/s", "20240101T000000Z")
    landing.land_snapshot(df, f"{folder}/s", "20240201T000000Z")
    assert landing.newest_snapshot(spark, f"{folder}/s", schemas.ENTITY_LIST).count() == 2
    with open(f"{folder}/list.csv", "w", encoding="utf-8") as f:
        f.write("city,country_code\nSão Paulo,BR\nNew York,US\n")
    assert tuples(landing.read_entity_list(spark, f"{folder}/list.csv"), "city") == [
        ("New York", "US"), ("São Paulo", "BR"),
    ]


def test_blank_lines_are_skipped(spark, folder):
    os.makedirs(f"{folder}/s/snapshot=1")
    with open(f"{folder}/s/snapshot=1/a.json", "w", encoding="utf-8") as f:
        f.write('{"city": "A", "country_code": "X"}\n\n{"city": "B", "country_code": "X"}\n')
    assert landing.newest_snapshot(spark, f"{folder}/s", schemas.ENTITY_LIST).count() == 2
