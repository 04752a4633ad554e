from __future__ import annotations

import gzip
import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows, least=warc.LEAST):
    """(page_id, payload_bytes, digest, type, refers_to) of every row, by comparing all payloads."""
    known = [(p, (h or "").encode()) for p, _, h in rows]
    found = []
    for page, payload in known:
        same = [p for p, other in known if other == payload and p is not None]
        first = min(same) if same and len(payload) >= least else None
        again = first is not None and (page is None or page > first)
        found.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(found, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture
def place(tmp_path):
    return lambda: f"file://{tmp_path}/{uuid.uuid4().hex}"


LONG = "<p>é" * 60
ROWS = [
    (5, "http://a/1", LONG), (3, "http://a/2", LONG), (3, "http://a/2", LONG), (9, None, LONG), (None, "http://n", LONG),
    (1, "u", "x" * 99), (2, "u", "x" * 99), (7, "u", "y" * 100), (8, "u\r\nX: y", "y" * 100), (8, "v", "z" * 100),
    (4, "", None), (6, "http://ü/ö?a=%20 b", ""), (None, None, None), (-(2**63), "low", "w" * 200), (2**63 - 1, "high", "w" * 200),
    (10, "body", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n" * 20), (11, "wide", "\x00 𝄞" * 50_000),
]


def test_round_trip_equals_brute_force(session, clashing, place):
    pages = clashing(session.createDataFrame(ROWS, PAGES)).withColumn("digest", F.lit("x")).withColumn("shard", F.lit("x"))
    files = warc.write_archives(pages, place(), goal=2000, roll=500)
    assert got(warc.read_archives(files)) == brute(ROWS)
    texts = {(r["page_id"], r["payload_digest"]): bytes(r["html"]) for r in warc.read_archives(files, payloads=True).collect() if r["html"] is not None}
    for page, _, html in ROWS:
        digest = hashlib.sha256((html or "").encode()).hexdigest()
        if (page, digest) in texts:
            assert texts[page, digest] == (html or "").encode()
    assert {f["number"] for f in files.collect()} > {0}


def test_random_pages(session, place):
    draw = random.Random(5)
    rows = [(draw.choice([None, *range(300)]), f"http://h/{k}", draw.choice("abcdef") * draw.choice([0, 99, 100, 101, 400])) for k in range(800)]
    rows += [(10**12 + k * 10**6, "far", f"only {k} " * 30) for k in range(200)]
    pages = session.createDataFrame(rows, PAGES)
    for goal in (None, 30_000, 3_000):
        assert got(warc.read_archives(warc.write_archives(pages, place(), goal=goal, roll=2000))) == brute(rows)


def test_files_depend_on_the_rows_alone(session, place):
    rows = [(k, f"http://h/{k}", f"page {k % 700} " * 40) for k in range(1000)]
    seen = []
    for parts in (1, 7):
        pages = session.createDataFrame(rows, PAGES).repartition(parts, "url")
        files = warc.write_archives(pages, place(), goal=50_000, roll=3000).collect()
        seen.append(sorted((f["path"].rsplit("/", 1)[1], f["records"], f["sha256"]) for f in files))
    assert seen[0] == seen[1]
    # Shards follow one another in the order of the ids and none is much above the goal.
    assert len({name.split("-")[1] for name, _, _ in seen[0]}) > 5


def test_one_id_with_most_rows_is_dealt_to_several_shards(session, place):
    rows = [(7, "hot", "h" * 300)] * 400 + [(7, "hot", f"v{k}" * 100) for k in range(100)] + [(k, "u", "h" * 300) for k in (3, 50)]
    files = warc.write_archives(session.createDataFrame(rows, PAGES), place(), goal=20_000)
    assert got(warc.read_archives(files)) == brute(rows)
    assert max(f["records"] for f in files.collect()) < 200


def test_archives_are_plain_warc(session, place):
    folder = place()
    files = warc.write_archives(session.createDataFrame([(1, "http://a/ä b", "t" * 150), (2, "http://c", "t" * 150)], PAGES), folder)
    raw = gzip.open(files.first()["path"].removeprefix("file:"), "rb").read()
    assert raw.count(b"WARC/1.1\r\n") == 3 and b"WARC-Target-URI: http://a/%C3%A4%20b\r\n" in raw
    assert raw.count(warc.record_id(1, hashlib.sha256(b"t" * 150).hexdigest(), "http://a/ä b").encode()) == 2


def test_readers_see_committed_and_unchanged_files_only(session, place):
    folder = place()
    with pytest.raises(FileNotFoundError):
        warc.manifest(session, folder)
    files = warc.write_archives(session.createDataFrame([(1, "u", "t" * 150)], PAGES), folder)
    local = files.first()["path"].removeprefix("file://")
    open(f"{local}.stray.warc.gz", "wb").write(b"left over")
    assert warc.read_archives(warc.manifest(session, folder)).count() == 1
    data = open(local, "rb").read()
    other = warc.page_record(1, "u", b"s" * 150, None)
    open(local, "wb").write(data + other)
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read_archives(warc.manifest(session, folder)).collect()
    open(local, "wb").write(data[:-20])
    with pytest.raises(Exception, match="cut"):
        warc.read_archives(warc.manifest(session, folder)).collect()


def test_empty_table(session, place):
    files = warc.write_archives(session.createDataFrame([], PAGES), place())
    assert files.collect() == [] and warc.read_archives(files).collect() == []
