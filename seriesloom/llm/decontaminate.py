"""Benchmark decontamination as a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item (or a shorter item whole). Its shingles, runs of up to five
words, are ordered by how rare they are in the documents. Since a window must occur in full, the overlap
needed is all of its shingles, and the prefix that every match must share is the single rarest one. Documents are
joined to windows on that shingle only; the shingle's place in the window bounds the place and length of the
possible occurrence (it must lie inside the document), and the words there are compared exactly.

The corpus is read once. A bitmap of fixed size over all windows' shingles (a Bloom filter with one
hash) is the only thing sent to the tasks, whatever the size of the benchmark; each document keeps only
its runs of words that can matter, and everything after works on those. A text of any length takes rows in proportion to
its words, also where all of it lies in the benchmark. A passage shared by many
documents is counted by partial sums, and joins on its shingle are plain equi-joins that adaptive
execution can split.

Null texts have no words; items without words have no windows; repeated items count once per item_id, items with
equal windows are all named. Repeated documents are judged row by row. Texts of NULL item_id are not
named but do hit. Extra columns are ignored. With no benchmark rows nothing is hit; with no documents
there are no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import byte_words, only, shingle_hashes, word_hashes, words
from seriesloom.session import store

WINDOW = 13
SHINGLE = 5
BITS = 24


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words (array) of every window, once per item."""

    def cut(batches):
        for batch in batches:
            items, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(text.as_py())
                for at in range(max(1, len(own) - window + 1) if own else 0):
                    items.append(item)
                    found.append(own[at : at + window])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(found, pa.list_(pa.string()))], ["item_id", "words"])

    texts = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return texts.mapInArrow(cut, "item_id string, words array<string>").distinct()


def _bitmap(distinct: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits of all shingle hashes, and the shingle lengths in use (at most SHINGLE of them)."""

    def hashes(batches):
        for batch in batches:
            marks: dict[tuple[int, int], int] = {}
            for found in batch.column("words").to_pylist():
                size = min(SHINGLE, len(found))
                for h in (shingle_hashes(word_hashes([w.encode() for w in found]), size) >> np.uint64(64 - BITS)).tolist():
                    marks[size, h >> 5] = marks.get((size, h >> 5), 0) | 1 << (h & 31)
            sizes, places = ([k[i] for k in marks] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int32()), pa.array(places, pa.int32()), pa.array(list(marks.values()), pa.int64())],
                ["size", "place", "bits"])

    # At most SHINGLE * 2^BITS / 32 rows, however large the benchmark is.
    rows = distinct.mapInArrow(hashes, "size int, place int, bits long").groupBy("size", "place").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    np.bitwise_or.at(bitmap, rows.column("place").to_numpy(), rows.column("bits").to_numpy().astype(np.uint32))
    return bitmap, sorted(set(rows.column("size").to_pylist()))


def runs(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """Per document: row (a number of its own), doc_id, n_words, and its runs of words that may lie in windows."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, sizes))

    def scan(batches):
        only("words")
        bits, used = shared.value
        for batch in batches:
            counts, starts, found = [], [], []
            for text in batch.column("text"):
                own = byte_words(text.as_py())
                counts.append(len(own))
                here, kept = [], []
                if own and used:
                    hashed, cover = word_hashes(own), np.zeros(len(own) + 1, np.int32)
                    for size in used:
                        h = shingle_hashes(hashed, size) >> np.uint64(64 - BITS)
                        hit = np.flatnonzero(bits[h >> np.uint64(5)] >> (h & np.uint64(31)).astype(np.uint32) & np.uint32(1))
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, hit + size, -1)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]])))
                    for a, b in edges.reshape(-1, 2).tolist():
                        here.append(a)
                        kept.append([w.decode() for w in own[a:b]])
                starts.append(here)
                found.append(kept)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                pa.array(found, pa.list_(pa.list_(pa.string())))], ["doc_id", "n_words", "starts", "runs"])

    scanned = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        scan, _scan_schema(docs))
    # Numbered before it is stored, so the numbers stay the same in every later read.
    return store(scanned.withColumn("row", F.monotonically_increasing_id()), "runs")


def _scan_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, starts array<int>, runs array<array<string>>"


def _shingles(words_column, first, size=SHINGLE):
    """Array of (shingle, at) for a column of word arrays; arrays shorter than ``size`` are one shingle."""
    last = F.greatest(F.size(words_column) - size, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
        F.array_join(F.slice(words_column, k + 1, size), " ").alias("shingle"), (k + first).alias("at")))


def occurrences(scanned: DataFrame, listed: DataFrame) -> DataFrame:
    """Exact occurrences of the listed windows (window, words): row, start, length, window.

    Shingles travel alone; the words of a run meet the places that may match in it once, and only as many as the window
    has are cut out for each, so a text of L words costs L small rows however much of it lies in windows.
    """
    pieces = store(scanned.where(F.size("runs") > 0).select("row", F.explode(F.arrays_zip("starts", "runs")).alias("z")).select(
        "row", F.col("z.starts").alias("base"), F.col("z.runs").alias("found")), "pieces")
    lengths = [r[0] for r in listed.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect()]
    if not lengths:
        return pieces.select("row", F.col("base").alias("start"), F.col("base").alias("length"), F.lit(0).cast("long").alias("window")).where(F.lit(False))
    by_length = [
        pieces.where(F.size("found") >= n).select("row", "base", F.size("found").alias("size"), F.explode(_shingles(F.col("found"), F.lit(0), n)).alias("s"))
        for n in lengths
    ]
    tokens = functools.reduce(DataFrame.unionByName, by_length).select("row", "base", "size", "s.shingle", "s.at")
    frequency = tokens.groupBy("shingle").agg(F.count("*").alias("n"))
    in_windows = listed.select("window", F.size("words").alias("length"), F.explode(_shingles(F.col("words"), F.lit(0))).alias("s")).select(
        "window", "length", "s.shingle", "s.at")
    # A window with a shingle that no document has cannot occur: the inner join and the count drop it.
    ranked = in_windows.join(frequency, "shingle")
    prefix = ranked.groupBy("window").agg(
        F.min(F.struct("n", "at", "shingle")).alias("rarest"), F.count("*").alias("present"), F.first("length").alias("length"))
    prefix = prefix.where(F.col("present") == F.greatest(F.col("length") - SHINGLE + 1, F.lit(1))).select(
        "window", "length", F.col("rarest.shingle").alias("shingle"), F.col("rarest.at").alias("inside"))
    start = F.col("at") - F.col("inside")
    places = tokens.join(prefix, "shingle").where((start >= 0) & (start + F.col("length") <= F.col("size"))).select(
        "row", "base", start.alias("inside_run"), "length", "window")
    cut = places.join(pieces, ["row", "base"]).select(
        "row", (F.col("base") + F.col("inside_run")).alias("start"), "length", "window",
        F.slice("found", F.col("inside_run") + 1, F.col("length")).alias("here"))
    return cut.join(listed, "window").where(F.col("here") == F.col("words")).select("row", "start", "length", "window")


def covered(found: DataFrame) -> DataFrame:
    """row, n_hit: positions under any occurrence, from the occurrences in order. A document has at most as many as words."""
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))
    return found.select("row", "start", "length").distinct().select("row", F.greatest(end - reached, F.lit(0)).alias("new")).groupBy(
        "row").agg(F.sum("new").alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    cut = store(windows(benchmark, window), "cut")
    listed = store(cut.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    bitmap, sizes = _bitmap(cut)
    scanned = runs(docs, bitmap, sizes)
    found = store(occurrences(scanned, listed), "occurrences")
    hits = covered(found)
    of_items = cut.where("item_id is not null").join(listed, "words").select("item_id", "window")
    named = found.select("row", "window").distinct().join(of_items, "window").groupBy("row").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    judged = scanned.select("row", "doc_id", "n_words").join(hits, "row", "left").join(named, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return judged.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce(F.array_size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns. Needs a doc_id per document: rows of an id go together."""
    judged = contamination(docs, benchmark)
    bad = judged.where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
