"""Phrases of two to four words from an FM-index per shard, summed across shards.

A shard holds about ``SHARD`` words of one language as numbers, with a zero between pieces. Its index is bidirectional: the
Burrows-Wheeler transforms of the numbers read forwards and backwards, sorted as deep as the phrases need. A phrase is
an interval in both. Extending it by one word on either side is one pass over the transform inside its interval: the
symbols there are the words that precede (or follow) it, their numbers the counts of the longer phrases, rank
queries give the new interval on that side and the numbers of smaller symbols the one on the other side. All
phrases of a length are extended at once: two words from one to the left, three from two to the right, four from three to the left.

A phrase can only be frequent if its head and its tail are. So the corpus is read once to write the indexes, and then
each length is one pass over them: a shard extends what may be frequent, the counts are added up by a
40-bit hash, as sorted tables that tasks merge, and the sums that reach ``least`` set bits in a bitmap of fixed size, the only thing that is sent to the next
pass. Hashes and bitmap only prune; they never lose a phrase, as a collision can only raise a sum. A last pass adds up
the words themselves, first within a task, so the counts are exact. Every longer phrase is the right extension of its head and the left
extension of its tail; the largest of those decides what is dropped.

Index files are written under a temporary name and moved into place, so a repeated task replaces a file by an equal one; no
group is ever in one task, and the hottest phrase of a language is one row per shard.

Null lang is ``und``. Null texts are empty; empty texts have no words. Repeated rows count each time, and doc_id is not
read. A word or a text may be of any length: a text longer than a shard is cut between words, and the phrases over
the cut are counted where they begin. Extra columns are ignored. Empty tables give no rows. Ties in score and
count are ordered by the phrase in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import mix, only
from seriesloom.session import store, work_dir

LONGEST = 4
LEAST = 30
TOP = 2000
SHARE = 80
# Numbers of a shard, boundaries included, and bytes of a text that are split at once.
SHARD = 1 << 21
STEP = 1 << 22
# Bits of a phrase's hash, and those of them that are its place in a bitmap.
KEY_BITS, BITS = 40, 25
# Shards per task, whose counts are added up before they leave it, and sums that a task holds.
TOGETHER = 16
HELD = 1 << 22
# Bytes of phrases, with their words, that a task adds up at once.
NAMED = 1 << 26
# Words per part of the sums.
PART = 1 << 21

# A-Z in lower case, separators of pieces to 0xFF (which UTF-8 never has), space and tab to space.
BOUNDARY = b"\xff"
FOLD = bytes(
    0xFF if c in b".,;:!?" or 10 <= c <= 13 else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Numbers(dict):
    """Words to numbers in order of appearance; 0 is the boundary."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def order(text: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Positions sorted by the next ``depth`` numbers (zeros after the end); each number has at most ``bits`` bits."""
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    n, each = len(text), max(1, 62 // bits)
    ranked, at = None, depth
    # From the last numbers to the first, as many in one key as fit; a rank stands for those already sorted.
    while at > 0:
        take = min(at, each if ranked is None else max(1, (62 - ranked[1]) // bits))
        key = np.zeros(n, np.int64)
        for k in range(at - take, at):
            key = key << bits | padded[k : k + n]
        if ranked is not None:
            key = key << ranked[1] | ranked[0]
        at -= take
        if at:
            _, rank = np.unique(key, return_inverse=True)
            ranked = rank, max(1, n.bit_length())
    return np.argsort(key, kind="stable")


def transform(text: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Burrows-Wheeler transform: the number before each position, in sorted order."""
    return text[order(text, depth, bits) - 1].astype(np.int32)


class Index:
    """Bidirectional index of one shard: intervals are (low, high) forwards and ``other``, the low end backwards."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, size: int):
        self.bits = max(1, len(forward).bit_length())
        self.sides = (forward, backward)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(forward, minlength=size))])
        self._places: list[np.ndarray | None] = [None, None]

    @classmethod
    def of(cls, text: np.ndarray, size: int, depth: int = LONGEST - 1) -> Index:
        bits = max(1, (size - 1).bit_length())
        return cls(transform(text, depth, bits), transform(text[::-1], depth, bits), size)

    def rank(self, side: int, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``end`` in the transform."""
        if self._places[side] is None:
            column = self.sides[side]
            self._places[side] = np.sort(column.astype(np.int64) << self.bits | np.arange(len(column)))
        return np.searchsorted(self._places[side], symbol.astype(np.int64) << self.bits | end) - self.starts[symbol]

    def words(self) -> tuple[np.ndarray, ...]:
        """(number, low, high, other) of all single words."""
        number = np.arange(1, len(self.starts) - 1)
        return number, self.starts[number], self.starts[number + 1], self.starts[number]

    def extend(self, side: int, low: np.ndarray, high: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions by one word, side 0 to the left and 1 to the right: (parent, word, low, high, other).

        ``low`` and ``high`` are the intervals on that side, ``other`` the low ends on the other one.
        """
        size = high - low
        parent = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(parent)) + np.repeat(low - (np.cumsum(size) - size), size)
        key, count = np.unique(parent << self.bits | self.sides[side][rows], return_counts=True)
        parent, symbol = key >> self.bits, key & ((1 << self.bits) - 1)
        # Smaller symbols of the same interval come first on the other side.
        before = np.cumsum(count) - count
        first = np.searchsorted(parent, np.arange(len(low)))
        beyond = other[parent] + before - before[first[parent]] if len(parent) else other[:0]
        inside = np.flatnonzero(symbol)
        parent, symbol, count, beyond = parent[inside], symbol[inside], count[inside], beyond[inside]
        start = self.starts[symbol] + self.rank(side, symbol, low[parent])
        return parent, symbol, start, start + count, beyond


def phrase_keys(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Hashes of phrases of ``KEY_BITS`` bits, from their words' hashes (phrases x words of numbers)."""
    total = np.zeros(len(numbers), np.uint64)
    with np.errstate(over="ignore"):
        for column in numbers.T:
            total = (total ^ hashes[column]) * np.uint64(0x9FB21C651E98DF25)
            total ^= total >> np.uint64(29)
    return mix(total) >> np.uint64(64 - KEY_BITS)


def word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def held_by(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(KEY_BITS - BITS)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def enumerate_phrases(index: Index, hashes: np.ndarray, bitmaps: list[np.ndarray], longest: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(numbers, keys, counts) of the phrases of 1, 2, ... words that may be frequent.

    A phrase is given if its head and tail are in the bitmap of their length, and extended if it is in the
    bitmap of its own; without bitmaps all words are given.
    """
    number, low, high, other = index.words()
    numbers = number[:, None]
    keys = hashes[number] if len(number) else hashes[:0]
    keys = phrase_keys(hashes, numbers)
    yield numbers, keys, high - low
    for size in range(2, longest + 1):
        if len(bitmaps) < size - 1:
            return
        known = held_by(bitmaps[size - 2], keys)
        numbers, low, high, other = numbers[known], low[known], high[known], other[known]
        left = size % 2 == 0
        if left:
            parent, word, new_low, new_high, new_other = index.extend(0, low, high, other)
            numbers = np.column_stack([word, numbers[parent]])
            added = numbers[:, :-1]
        else:
            parent, word, back_low, back_high, new_low = index.extend(1, other, other + (high - low), low)
            new_other, new_high = back_low, new_low + (back_high - back_low)
            numbers = np.column_stack([numbers[parent], word])
            added = numbers[:, 1:]
        # The parent is the tail (or the head) and known to be frequent; the other one is looked up.
        good = held_by(bitmaps[size - 2], phrase_keys(hashes, added))
        numbers, low, high, other = numbers[good], new_low[good], new_high[good], new_other[good]
        keys = phrase_keys(hashes, numbers)
        yield numbers, keys, high - low


def chunks(text: bytes, limit: int, reach: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Tokens of a text in chunks of about ``limit``, with those that the next chunk repeats.

    A cut inside a piece repeats up to ``reach`` words, so that no phrase over the cut is lost; phrases within the
    repeated words are then counted twice.
    """
    folded, at, found = text.translate(FOLD), 0, []
    while at < len(folded):
        end = at + STEP
        if end < len(folded):
            end = min(x if x >= 0 else len(folded) for x in (folded.find(b" ", end), folded.find(BOUNDARY, end)))
        found += folded[at:end].replace(BOUNDARY, b" \xff ").split()
        at = end
        while len(found) > limit + reach:
            again = []
            if found[limit - 1] != BOUNDARY:
                for word in found[limit : limit + reach]:
                    if word == BOUNDARY:
                        break
                    again.append(word)
            yield found[:limit] + again, again
            found = found[limit:]
    if found:
        yield found, []


class Shard:
    """Numbers of one language that are not written yet."""

    def __init__(self):
        self.numbers, self.parts, self.held = Numbers({BOUNDARY: 0}), [np.zeros(1, np.int32)], 1

    def add(self, found: list[bytes]) -> None:
        part = np.zeros(len(found) + 1, np.int32)
        part[:-1] = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        self.parts.append(part)
        self.held += len(part)


INDEXED = "lang string, path string, sign int, words long"


def build(docs: DataFrame, folder: str, longest: int = LONGEST, shard: int = SHARD) -> DataFrame:
    """Write one index file per shard below ``folder``: its lang, path, sign and number of words.

    Shards of sign -1 hold the words that chunks of very long texts repeat; their counts are taken off.
    """
    filesystem, root = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)

    def run(batches):
        only()
        target, base = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        shards: dict[tuple[str, int], Shard] = {}
        written = 0

        def flush(key: tuple[str, int]) -> pa.RecordBatch:
            nonlocal written
            own = shards.pop(key)
            text, words = np.concatenate(own.parts), list(own.numbers)[1:]
            index = Index.of(text, len(words) + 1, longest - 1)
            name = f"{context.partitionId():06d}-{written:05d}"
            written += 1
            unfinished = f"{base}/.{name}-{context.taskAttemptId()}"
            with target.open_output_stream(unfinished, compression=None) as sink:
                batch = pa.RecordBatch.from_pydict({
                    "forward": [index.sides[0].tobytes()], "backward": [index.sides[1].tobytes()], "words": [b"\n".join(words)],
                    "keys": [word_keys(key[0], words).tobytes()]})
                with pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
            target.move(unfinished, f"{base}/{name}.arrow")
            return pa.RecordBatch.from_pydict({
                "lang": [key[0]], "path": [f"{folder}/{name}.arrow"], "sign": pa.array([key[1]], pa.int32()),
                "words": pa.array([key[1] * int(np.count_nonzero(text))], pa.int64())})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for found, again in chunks(text.as_py() or b"", shard, longest - 1):
                    for sign, part in ((1, found), (-1, again)):
                        if part:
                            shards.setdefault((lang, sign), Shard()).add(part)
                    if sum(x.held for x in shards.values()) >= shard:
                        yield flush(max(shards, key=lambda k: shards[k].held))
        for key in list(shards):
            yield flush(key)

    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    return store(plain.mapInArrow(run, INDEXED), "indexes")


def load(path: str) -> tuple[Index, np.ndarray, bytes]:
    """Index, hashes by number, and joined words of a file."""
    filesystem, name = pafs.FileSystem.from_uri(path)
    with filesystem.open_input_file(name) as source:
        batch = pa.ipc.open_file(source).get_batch(0)
        forward, backward, keys = (np.frombuffer(batch.column(c)[0].as_buffer(), t) for c, t in (("forward", "<i4"), ("backward", "<i4"), ("keys", "<u8")))
        words = batch.column("words")[0].as_py()
    return Index(forward, backward, len(keys) + 1), np.concatenate([np.zeros(1, np.uint64), keys]), words


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sums of their numbers."""
    key, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order_ = np.argsort(key)
    key, n = key[order_], n[order_]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def packed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as differences and their numbers, byte by byte of all rows, so that the shuffle's compression finds the zeros."""
    step = np.diff(key, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-KEY_BITS // 8)]
    return step.T.tobytes() + n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = -(-KEY_BITS // 8)
    planes = np.frombuffer(data, np.uint8).reshape(width + 8, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, :width] = planes[:width].T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(planes[width:].T).view("<i8").ravel()


def _bounds(parts: int) -> np.ndarray:
    """Where the 2nd, 3rd, ... of ``parts`` equal ranges of the keys begins."""
    return (np.arange(1, parts, dtype=object) * (1 << KEY_BITS) // parts).astype(np.uint64)


def _survivors(indexes: DataFrame, bitmaps: list[np.ndarray], size: int, least: int, parts: int) -> DataFrame:
    """key of the phrases of ``size`` words whose hashes reach ``least`` over all shards.

    The range of keys is cut into ``parts``; a task sends its sums of a part as one value.
    """
    shared = indexes.sparkSession.sparkContext.broadcast(bitmaps)
    bounds = _bounds(parts)

    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cuts = [0, *np.searchsorted(key, bounds).tolist(), len(key)]
        full = [k for k in range(parts) if cuts[k + 1] > cuts[k]]
        values = [packed(key[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]]) for k in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(values, pa.binary())], ["part", "sums"])

    def run(batches):
        only()
        held, count = [], 0
        for batch in batches:
            for path, sign in zip(batch.column("path").to_pylist(), batch.column("sign").to_pylist(), strict=True):
                index, hashes, _ = load(path)
                for numbers, keys, n in enumerate_phrases(index, hashes, shared.value, size):
                    if numbers.shape[1] == size and len(keys):
                        held.append((keys, n * sign))
                        count += len(keys)
                if count >= HELD:
                    held = [_added(held)]
                    count = len(held[0][0])
                    # Sums that hardly shrink any more go on; the others wait for the next shard.
                    if count >= HELD // 2:
                        yield rows(*held[0])
                        held, count = [], 0
        if held:
            yield rows(*_added(held))

    def total(batches):
        only()
        held, count, part = [], 0, None

        def finished():
            key, n = _added(held)
            return pa.RecordBatch.from_arrays([pa.array(key[n >= least].astype(np.int64))], ["key"])

        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != part:
                    if held:
                        yield finished()
                    held, count, part = [], 0, number
                held.append(unpacked(data.as_py()))
                count += len(held[-1][0])
                if count >= HELD:
                    held = [_added(held)]
                    count = len(held[0][0])
        if held:
            yield finished()

    made = indexes.select("path", "sign").mapInArrow(run, "part int, sums binary")
    return store(made.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(total, "key long"), "frequent")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the keys; at most 2^BITS / 64 rows reach the driver, however many keys there are."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {KEY_BITS - BITS}) & 63L as int))")
    rows = keys.groupBy(F.shiftrightunsigned("key", KEY_BITS - BITS + 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _summed(held: list[pa.Table]) -> pa.Table:
    """Each phrase once with the sum of its numbers."""
    names = ["part", "lang", "phrase", "size"]
    return pa.concat_tables(held).group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*names, "n"])


def _sent(indexes: DataFrame, bitmaps: list[np.ndarray], parts: int) -> DataFrame:
    """part, sums: the phrases that may be frequent with their numbers, as Arrow streams.

    A task adds up its shards by the words themselves before anything leaves it; of each part of the keys it sends one value.
    """
    shared = indexes.sparkSession.sparkContext.broadcast(bitmaps)
    bounds = _bounds(parts)

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([("part", "ascending"), ("phrase", "ascending")])
        full, first = np.unique(table.column("part").to_numpy(), return_index=True)
        for part, at, end in zip(full.tolist(), first.tolist(), [*first[1:].tolist(), len(table)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table.slice(at, end - at).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "sums"])

    def run(batches):
        only()
        bits = shared.value
        held, count = [], 0
        for batch in batches:
            for lang, path, sign in zip(*(batch.column(c).to_pylist() for c in ("lang", "path", "sign")), strict=True):
                index, hashes, joined = load(path)
                words = pa.array([b"", *joined.split(b"\n")], pa.binary())
                for numbers, keys, n in enumerate_phrases(index, hashes, bits, len(bits)):
                    known = held_by(bits[numbers.shape[1] - 1], keys)
                    numbers, keys, n = numbers[known], keys[known], n[known]
                    for at in range(0, len(n), 50_000):
                        part = numbers[at : at + 50_000]
                        columns = [words.take(pa.array(c)) for c in part.T]
                        held.append(pa.table({
                            "part": pa.array(np.searchsorted(bounds, keys[at : at + 50_000], side="right").astype(np.int32)),
                            "lang": pa.array([lang]).take(pa.array(np.zeros(len(part), np.int8))),
                            "phrase": columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, b" "),
                            "size": pa.array(np.full(len(part), part.shape[1], np.int32)), "n": pa.array(n[at : at + 50_000] * sign)}))
                        count += held[-1].nbytes
                        if count >= NAMED:
                            held = [_summed(held)]
                            count = held[0].nbytes
                            if count >= NAMED // 2:
                                yield from rows(held[0])
                                held, count = [], 0
        if held:
            yield from rows(_summed(held))

    return indexes.select("lang", "path", "sign").mapInArrow(run, "part int, sums binary")


def _named(indexes: DataFrame, bitmaps: list[np.ndarray], least: int, parts: int) -> DataFrame:
    """lang, phrase, size, f of the phrases that may be frequent and occur ``least`` times or more."""
    def total(batches):
        only()
        held, count, limit, part = [], 0, NAMED, None

        def finished():
            table = _summed(held)
            table = table.filter(pc.greater_equal(table.column("n"), least)).select(["lang", "phrase", "size", "n"])
            return table.rename_columns(["lang", "phrase", "size", "f"]).to_batches()

        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != part:
                    if held:
                        yield from finished()
                    held, count, limit, part = [], 0, NAMED, number
                held.append(pa.ipc.open_stream(data.as_buffer()).read_all())
                count += held[-1].nbytes
                if count >= limit:
                    held = [_summed(held)]
                    count = held[0].nbytes
                    limit = max(NAMED, 2 * count)
        if held:
            yield from finished()

    found = _sent(indexes, bitmaps, parts).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(total, "lang string, phrase binary, size int, f long")
    return found.withColumn("phrase", F.col("phrase").cast("string"))


def phrase_counts(indexes: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, size, f of all phrases of up to ``longest`` words that occur ``least`` times or more."""
    shards, words = indexes.agg(F.count("*"), F.sum(F.abs("words"))).first()
    # Shards of a language go together, as they share most of their phrases, which are added up before they leave a task.
    spread = indexes.repartitionByRange(max(1, -(-shards // TOGETHER)), "lang", "path")
    parts = -(-(words or 0) // PART) + 1
    bitmaps: list[np.ndarray] = []
    for size in range(1, longest + 1):
        frequent = _survivors(spread, bitmaps, size, least, parts)
        if frequent.isEmpty():
            break
        bitmaps.append(_bitmap(frequent))
    named = _named(spread, bitmaps, least, parts) if bitmaps else _named(spread.where(F.lit(False)), [np.zeros(1 << (BITS - 6), np.uint64)], least, parts)
    return store(named, "phrases")


def scored(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more that no longer one makes superfluous."""
    exact = "decimal(20, 0)"
    longer = counts.where("size > 2").select("lang", F.col("f").alias("over"), F.explode(F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    # A longer phrase by more words occurs no more often than one of those by a single word.
    over = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = counts.where("size > 1").join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (
        F.col("over").cast(exact) * 100 < F.col("f").cast(exact) * share))
    cuts = kept.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("tail"))
    parts = counts.select("lang", "phrase", "f")
    both = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"cast(2000000 * cast(a as {exact}) div (cast(l as {exact}) + cast(r as {exact})) as long)")
    return both.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select(
        "lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")


def best_phrases(indexes: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The first ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    words = indexes.groupBy("lang").agg(F.sum("words").alias("n"))
    # The limit of a rank is applied before the shuffle as well, so no task gets more than tasks x top rows.
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(phrase_counts(indexes, least, longest), share).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame) -> DataFrame:
    """Index all documents in a new shared folder and rank their phrases."""
    folder = work_dir(docs.sparkSession, "phrases")
    return best_phrases(build(docs, folder if ":/" in folder else f"file://{folder}"))
