"""Shared helpers of the text operators: tables, hashes, words and connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import store

# Words of the contract for contamination, also used for shingles: runs of a-z, 0-9 and everything outside ASCII, after
# lower-casing A-Z only. In UTF-8 that is a table of bytes: letters folded, separators turned into spaces.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD_CACHE = 300_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, or the first one with underscores added that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def in_fold(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the id's fold is ``part``; false for a NULL id, which has none."""
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def words(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in byte_words(text)]


class Hashes(dict):
    """Cache of 64-bit word hashes. It starts anew when full, which changes no value."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = Hashes()

# Caches of this worker process by name. Workers live on from stage to stage, so an operator lets go of the others'.
_HELD: dict[str, Callable[[], None]] = {"words": _HASHES.clear}


def hold(name: str, release: Callable[[], None]) -> None:
    """Make a cache known, with what empties it."""
    _HELD[name] = release


def only(name: str = "") -> None:
    """At the start of a task: empty all caches but ``name`` and give unused Arrow memory back."""
    for other, release in _HELD.items():
        if other != name:
            release()
    pa.default_memory_pool().release_unused()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in text order; none where there are fewer words."""
    count = len(hashed) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = (total ^ hashed[k : k + count]) * np.uint64(0x9FB21C651E98DF25)
            total ^= total >> np.uint64(29)
    return mix(total)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (2.0**-53)


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """Smallest id reachable over undirected links (columns a, b): one row (id, component) per linked id.

    Alternates the large-star and small-star steps, which keep every component connected and end when
    each member points at its smallest id. Every round is one written table, so a lost executor costs
    at most a round. Hot ids are met by partial aggregation before the shuffle and by joins that
    adaptive execution can split. Self links and NULL ends are ignored.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    current = store(both, name)
    if current.isEmpty():
        return current.select(F.col("v").alias("id"), F.col("u").alias("component"))
    while True:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        sides = current.union(current.select("u", "v")).toDF("node", "other")
        least = sides.groupBy("node").agg(F.min("other").alias("low"))
        least = least.select("node", F.least("node", "low").alias("low"))
        large = sides.join(least, "node").where("other > node").select(F.col("other").alias("v"), F.col("low").alias("u"))
        large = large.where("v <> u").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        small = large.groupBy("v").agg(F.min("u").alias("low"))
        joined = large.join(small, "v")
        after = joined.select(F.col("u").alias("v"), F.col("low").alias("u")).where("v <> u").union(
            small.select("v", F.col("low").alias("u"))).distinct()
        following = store(after, name)
        # Done when every node has one smaller neighbour and none of those is itself a larger end.
        tops = following.select(F.col("u").alias("v")).distinct()
        open_ends = following.groupBy("v").count().where("count > 1").select("v").union(
            following.select("v").distinct().join(tops, "v"))
        current = following
        if open_ends.isEmpty():
            return current.select(F.col("v").alias("id"), F.col("u").alias("component"))
