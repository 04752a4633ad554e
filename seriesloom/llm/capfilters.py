"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

Filter directions are concatenations of one random unit code word per block of coordinates, after a random
rotation: ``words``^``blocks`` directions from only blocks * words code words. A vector is list-decoded to all
directions whose inner product with it reaches a bound (branches of the product that cannot reach it are
cut), at least to its ``LEAST`` best ones. Vectors of one label that share a direction are
compared in double precision, so no pair below the limit is linked.

The bound gives about ``HITS`` directions a vector; the number of code words follows from the largest label's size, so
that a direction holds about ``FILL`` vectors of a label however many vectors there are. Two vectors
at the limit of 0.98 share most of their directions; the tests measure recall against brute force.

Equal vectors of a label form a class; only one of its rows is compared, so thousands of copies make no
pairs, yet each counts as linked with all others. Vectors with a null label, or that are null, zero, or hold
null or non-finite components, link with nothing and come out as they are; vectors of different length
are not compared. Every row is a vector of its own: rows of one vec_id count as copies if their vectors agree, else as different
vectors. A NULL vec_id links like others; it names no component, so one without any other id is NULL, and it is never kept.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import components
from seriesloom.session import store

LIMIT = 0.98
HITS = 24
LEAST = 8
FILL = 4
BLOCKS = 3


class Codes(NamedTuple):
    """Rotation, code words of each block (unit length) and the bound on the summed inner products."""

    rotation: np.ndarray
    words: list[np.ndarray]
    bound: float


def make_codes(dimension: int, largest: int, seed: int = 7) -> Codes:
    """Codes for vectors of one length; ``largest`` is the size of the largest label."""
    blocks = min(BLOCKS, dimension)
    count = max(4, round((max(1, largest) * HITS / FILL) ** (1 / blocks)))
    random = np.random.default_rng(seed + dimension)
    rotation, _ = np.linalg.qr(random.normal(size=(dimension, dimension)))
    words = []
    for part in np.array_split(np.arange(dimension), blocks):
        code = random.normal(size=(count, len(part)))
        words.append(code / np.linalg.norm(code, axis=1, keepdims=True))
    share = min(0.5, HITS / count**blocks)
    bound = NormalDist().inv_cdf(1 - share) * np.sqrt(blocks / dimension)
    return Codes(rotation, words, float(bound))


def decode(scores: list[np.ndarray], bound: float) -> np.ndarray:
    """Numbers of all products of code words whose scores add up to ``bound`` or more."""
    best = [s.max() for s in scores]
    total, number = np.zeros(1), np.zeros(1, np.int64)
    for k, s in enumerate(scores):
        still = sum(best[k + 1 :])
        chosen = np.flatnonzero(s + total.max() + still >= bound)
        sums = total[:, None] + s[chosen][None, :]
        rows, columns = np.nonzero(sums + still >= bound)
        total, number = sums[rows, columns], number[rows] * len(s) + chosen[columns]
        if not len(total):
            return number
    return number


def filters(vector: np.ndarray, codes: Codes) -> np.ndarray:
    """Filter numbers of a unit vector: all above the bound, and at least the LEAST best."""
    turned = codes.rotation @ vector
    parts = np.split(turned, np.cumsum([w.shape[1] for w in codes.words])[:-1])
    scores = [w @ p for w, p in zip(codes.words, parts, strict=True)]
    bound = codes.bound
    top = sum(s.max() for s in scores)
    found = decode(scores, bound)
    possible = int(np.prod([len(s) for s in scores]))
    while len(found) < min(LEAST, possible):
        # Lower the bound until enough directions exceed it; ties at the end are all kept.
        bound = top - 1.5 * max(top - bound, 0.02) if bound < top else top - 0.02
        found = decode(scores, bound)
    return found


def unit(values: list | None) -> np.ndarray | None:
    """The vector in double precision at length one, or None if it links with nothing."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    vector = np.asarray(values, float)
    if not np.isfinite(vector).all():
        return None
    vector = vector / (np.abs(vector).max() or 1.0)
    length = np.sqrt((vector**2).sum())
    return vector / length if length > 0 else None


def near_vectors(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    if not 0.9 <= limit <= 1:
        raise ValueError("the filters are made for cosines of 0.9 and more")
    source = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))

    def normalise(batches):
        for batch in batches:
            units = [unit(v) for v in batch.column("embedding").to_pylist()]
            labels = batch.column("label").to_pylist()
            units = [u if label is not None else None for u, label in zip(units, labels, strict=True)]
            raw = batch.column("embedding").to_pylist()
            keys = [
                hashlib.blake2b((np.asarray(v, float) + 0.0).tobytes(), digest_size=16).digest() if u is not None else None
                for u, v in zip(units, raw, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()),
                pa.array([None if u is None else u.tolist() for u in units], pa.list_(pa.float64()))],
                ["vec_id", "label", "key", "unit"])

    # Rows go by a number of their own, so ids may be NULL or stand for several vectors.
    units = store(source.mapInArrow(normalise, "vec_id long, label string, key binary, unit array<double>").withColumn(
        "row", F.monotonically_increasing_id()), "units")
    valid = units.where("key is not null")
    same = valid.groupBy("label", "key").agg(
        F.min("row").alias("class_id"), F.min("vec_id").alias("low"), F.count("*").alias("size")).where("size > 1")
    # A class is named by one of its rows; rows of single vectors need no join.
    member = valid.join(same, ["label", "key"], "left").select(
        "vec_id", "row", "label", "unit", F.coalesce("class_id", "row").alias("class_id"),
        F.when(F.col("class_id").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("low"), F.coalesce("size", F.lit(1)).alias("size"))
    member = store(member, "members")
    heads = member.where("row = class_id")

    # One row per vector length in use; a table holds a handful of them.
    sizes = heads.groupBy(F.size("unit").alias("n"), "label").count().groupBy("n").agg(F.max("count").alias("largest")).collect()
    shared = vectors.sparkSession.sparkContext.broadcast({r["n"]: make_codes(r["n"], r["largest"]) for r in sizes})

    def assign(batches):
        codes = shared.value
        for batch in batches:
            found = [filters(np.asarray(u.values), codes[len(u)]) for u in batch.column("unit")]
            yield pa.RecordBatch.from_arrays([
                batch.column("class_id"), batch.column("label"), pa.array([len(u) for u in batch.column("unit")], pa.int32()),
                pa.array(found, pa.list_(pa.int64()))], ["id", "label", "n", "filters"])

    assigned = heads.select("class_id", "label", "unit").mapInArrow(assign, "id long, label string, n int, filters array<long>")
    entries = store(assigned.select("id", "label", "n", F.explode("filters").alias("filter")), "filters")
    a, b = (entries.select("label", "n", "filter", F.col("id").alias(side)) for side in ("a", "b"))
    pairs = a.join(b, ["label", "n", "filter"]).where("a < b").select("label", "a", "b").distinct()

    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.stack([np.asarray(u.values) for u in batch.column(c)]) if _even(batch.column(c)) else None for c in ("unit_a", "unit_b"))
            if x is not None and y is not None and x.shape == y.shape:
                cosine = np.einsum("ij,ij->i", x, y)
            else:
                cosine = np.array([float(np.dot(np.asarray(p.values), np.asarray(q.values)))
                                   for p, q in zip(batch.column("unit_a"), batch.column("unit_b"), strict=True)])
            yield batch.select(["label", "a", "b"]).filter(pa.array(cosine >= limit))

    left = heads.select("label", F.col("class_id").alias("a"), F.col("unit").alias("unit_a"))
    right = heads.select("label", F.col("class_id").alias("b"), F.col("unit").alias("unit_b"))
    candidates = pairs.join(left, ["label", "a"]).join(right, ["label", "b"]).select("label", "a", "b", "unit_a", "unit_b")
    links = store(candidates.mapInArrow(check, "label string, a long, b long"), "links")

    weights = heads.select("label", F.col("class_id").alias("other"), "size")
    both = links.select("label", F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("label", "b", "a"))
    linked = both.join(weights, ["label", "other"]).groupBy("label", F.col("id").alias("class_id")).agg(F.sum("size").alias("others"))
    reached = components(links.select("a", "b"), "vector-links").select(F.col("id").alias("class_id"), "component")
    named = reached.union(reached.select("component", "component").distinct()).distinct().join(heads.select("class_id", "low"), "class_id")
    lowest = named.groupBy("component").agg(F.min("low").alias("lowest"))
    reached = named.select("class_id", "component").join(lowest, "component").select("class_id", "lowest", F.lit(True).alias("joined"))
    counted = member.select("vec_id", "label", "class_id", "low", "size").join(linked, ["label", "class_id"], "left").join(reached, "class_id", "left")
    result = counted.select(
        "vec_id", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"),
        F.when(F.col("joined"), F.col("lowest")).otherwise(F.col("low")).alias("component_id"))
    alone = units.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _even(column) -> bool:
    lengths = {len(u) for u in column}
    return len(lengths) == 1
