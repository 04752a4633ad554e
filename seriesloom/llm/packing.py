"""Best-fit packing of documents into sequences, after fixing provably dominating sets.

Sizes are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity``
counts, whatever the number of documents. The plan is made on that histogram:

1. Dominance (Martello and Toth): a size j is fixed together with a set that dominates every other set
   a bin with j could hold. A set dominates another if the other's items can be dealt out to places
   of the first that are at least as large; exchanging them never needs more bins. Proven cases:
   nothing fits beside j; one item fills j's bin exactly; at most one item fits, then the largest;
   at most two fit and the largest single outweighs each pair; at most two fit and {largest, b} has
   each feasible pair's second item at most b. Removing items keeps these facts true, so a set is
   fixed for all of its copies at once, and the pass repeats until nothing changes.
2. Best fit, largest sizes first, for the rest. Bins with the same free space are kept as ranges.

The plan's rows say for the r-th document of a size which sequence and offset it gets. Documents are
numbered within their size by one range-partitioned sort, whose second key spreads a size that many
documents share over many tasks; no task and no driver sees more than counts.

Null texts count as empty: one end id. Repeated rows are packed one by one, ties are broken by a hash of the
id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import only
from seriesloom.llm.tokens import encoder
from seriesloom.session import store

CAPACITY = 2048


class Step(NamedTuple):
    """``bins`` sequences from ``first`` on get ``each`` documents of ``size`` one after the other at ``offset``."""

    size: int
    first: int
    bins: int
    each: int
    offset: int


def dominating_set(left: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set that may be fixed with one item of size j, or None. ``left`` counts the items by size."""
    room = capacity - j
    left[j] -= 1
    try:
        sizes = np.flatnonzero(left)
        fitting = sizes[: np.searchsorted(sizes, room, "right")]
        if not len(fitting):
            return ()
        most = int(fitting[-1])
        if most == room:
            return (most,)
        small = np.repeat(fitting[:3], np.minimum(left[fitting[:3]], 3))[:3]
        if len(small) < 2 or small[0] + small[1] > room:
            return (most,)
        if len(small) == 3 and small.sum() <= room:
            return None
        # Largest partner for each possible first item of a pair.
        best = second = 0
        for y in map(int, fitting):
            k = int(np.searchsorted(fitting, room - y, "right")) - 1
            if k >= 0 and int(fitting[k]) == y and left[y] < 2:
                k -= 1
            if k < 0:
                continue
            x = int(fitting[k])
            best, second = max(best, x + y), max(second, min(x, y))
        if most >= best:
            return (most,)
        left[most] -= 1
        rest = fitting[: np.searchsorted(fitting, room - most, "right")]
        rest = rest[left[rest] > 0]
        left[most] += 1
        if len(rest) and int(rest[-1]) >= second:
            return (most, int(rest[-1]))
        return None
    finally:
        left[j] += 1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """Steps that place every item, and the number of sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for size, count in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} does not fit into {capacity}")
        left[size] += count
    steps: list[Step] = []
    bins = 0
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(left)[::-1].tolist():
            while left[j]:
                fixed = dominating_set(left, j, capacity)
                if fixed is None:
                    break
                members = (j, *fixed)
                times = min(int(left[s]) // members.count(s) for s in set(members))
                at = 0
                for s in dict.fromkeys(members):
                    steps.append(Step(s, bins, times, members.count(s), at))
                    at += s * members.count(s)
                    left[s] -= times * members.count(s)
                bins += times
                changed = True
    return _best_fit(left, capacity, steps, bins)


def _best_fit(left: np.ndarray, capacity: int, steps: list[Step], bins: int) -> tuple[list[Step], int]:
    free: dict[int, list[tuple[int, int]]] = {}  # free space: ranges (first sequence, how many)
    spaces: list[int] = []  # its keys in order

    def give_back(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in free:
                bisect.insort(spaces, space)
                free[space] = []
            free[space].append((first, count))

    for size in np.flatnonzero(left)[::-1].tolist():
        count = int(left[size])
        while count:
            k = bisect.bisect_left(spaces, size)
            if k < len(spaces):
                space = spaces[k]
                first, have = free[space].pop()
                if not free[space]:
                    del free[space], spaces[k]
            else:
                space, first, have = capacity, bins, -(-count // (capacity // size))
                bins += have
            each = space // size
            whole = min(have, count // each)
            if whole:
                steps.append(Step(size, first, whole, each, capacity - space))
                give_back(space - each * size, first, whole)
                count -= whole * each
            if whole < have:
                rest = min(count, each)
                if rest:
                    steps.append(Step(size, first + whole, 1, rest, capacity - space))
                    give_back(space - rest * size, first + whole, 1)
                    count -= rest
                    give_back(space, first + whole + 1, have - whole - 1)
                else:
                    give_back(space, first + whole, have - whole)
    return steps, bins


class Lookup:
    """The plan as arrays: size and rank to sequence and offset."""

    def __init__(self, steps: list[Step]):
        by_size: dict[int, list[Step]] = {}
        for step in steps:
            by_size.setdefault(step.size, []).append(step)
        self.by_size = {}
        for size, own in by_size.items():
            counts = np.array([s.bins * s.each for s in own], np.int64)
            self.by_size[size] = (np.concatenate([[0], np.cumsum(counts)[:-1]]), np.array(own, np.int64))

    def place(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, own = self.by_size[size]
        k = np.searchsorted(starts, rank, "right") - 1
        within, step = rank - starts[k], own[k]
        return step[:, 1] + within // step[:, 3], step[:, 4] + within % step[:, 3] * size


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of all documents: doc_id, piece, start, length, ids_crc32.

    Only documents of more than ``capacity`` ids are cut; the first piece takes what is left over.
    """

    def cut(batches):
        only("tokens")
        encode_all, end = encoder(tokenizer).encode_all, np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1)), strict=True):
                ids += end
                total = len(ids) // 4
                first = total % capacity or capacity
                for piece, stop in enumerate(range(first, total + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            if rows:
                doc, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of ``pieces``)."""

    def number(batches):
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = np.empty(len(length), np.int64)
            # Sorted by length, so equal lengths lie together.
            cuts = np.flatnonzero(np.diff(length)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(length)], strict=True):
                if b > a:
                    before = seen.get(int(length[a]), 0)
                    rank[a:b] = np.arange(before, before + b - a)
                    seen[int(length[a])] = before + b - a
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rank), pa.array(np.full(len(length), part, np.int32))],
                [*batch.schema.names, "rank", "part"])

    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    ordered = items.withColumn("spread", spread).repartitionByRange("length", "spread").sortWithinPartitions(
        "length", "spread").drop("spread")
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int"
    numbered = store(ordered.mapInArrow(number, columns), "numbered")
    # Counts by (task, length): each task holds a range of lengths, so at most tasks + capacity rows.
    counts = sorted(tuple(r) for r in numbered.groupBy("length", "part").count().collect())
    offsets: dict[tuple[int, int], int] = {}
    totals: dict[int, int] = {}
    for length, part, count in counts:
        offsets[part, length] = totals.get(length, 0)
        totals[length] = totals.get(length, 0) + count
    steps, _ = plan(totals, capacity)
    shared = items.sparkSession.sparkContext.broadcast((offsets, steps))

    def place(batches):
        offsets, steps = shared.value
        lookup = Lookup(steps)
        for batch in batches:
            length, part = batch.column("length").to_numpy(), batch.column("part").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for key in np.unique(np.stack([part, length]), axis=1).T.tolist():
                rows = np.flatnonzero((part == key[0]) & (length == key[1]))
                sequence[rows], offset[rows] = lookup.place(key[1], rank[rows] + offsets[key[0], key[1]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                      "sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack all documents. The pieces are stored once, as counting and placing both read them."""
    return pack(store(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
