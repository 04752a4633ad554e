"""Alignment of two tokenizers by pointer jumping over overlapping tokens, with corpus-wide counts of linked ids.

Both tokenizers read the same bytes: a space and the text. Every token points to the farthest-right token of the other
side that it overlaps, the one that holds its last byte; a token of the first side whose end is an end on the other
side as well points to itself. Replacing every pointer by its pointer's pointer, for all tokens of all
new words of a batch at once, doubles the distance in each round and ends at the last token of each
connected component. These terminals number the groups: the stretches between offsets where both sides end.

Both vocabularies cut a text at single spaces, before line ends, and between a Latin letter and a mark, and every such cut is an
end on both sides. So a chunk's groups do not depend on its neighbours, and the aligned chunks are kept in a bounded cache. Texts with other
white space are aligned whole. The tests compare with the libraries on whole texts.

The links of an id pair are counted per document: (1) one pass aligns every document and stores its distinct pairs with
their multiplicities; (2) documents per pair are added up, in each task first; (3) the highest count of each first id follows
from those; (4) the documents get the counts of their pairs. Up to ``LOOKUP`` pairs the counts are read
from the shared folder by every task; beyond that the pairs are joined with them. Both give the same rows.

Null and empty texts, and texts that a side does not give back byte for byte (such as those with U+2581), have no tokens: zeros and
an empty digest. Texts of any length are aligned whole. Repeated doc_ids are separate documents; a NULL doc_id is
kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import hold, only
from seriesloom.llm.tokens import LATIN, SPACE, Encoder, odd, public_path
from seriesloom.session import store

# Pairs whose counts every task may hold: 17 bytes each, so 68 MB.
LOOKUP = 4_000_000
# Chunks that are kept, and bytes of their groups.
CACHE, HELD = 300_000, 1 << 26
# Chunks that are joined into documents at once.
TURN = 100_000
# Marks the text of a chunk that has no space before it.
ALONE = "\x01"
LETTERS = re.compile(f"[{LATIN}]+")
MARK = re.compile(rf"(?<=[{LATIN}])([!-&(-/:-@\[-`{{-~])")


def labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token of either side, from the byte offsets where they end.

    Both sides cover the same bytes without gaps, and no token is empty.
    """
    n = len(ends_a)
    holder = np.searchsorted(ends_b, ends_a)
    following = np.concatenate([
        np.where(ends_b[holder] == ends_a, np.arange(n), n + holder) if n else holder, np.searchsorted(ends_a, ends_b)])
    while True:
        farther = following[following]
        if np.array_equal(farther, following):
            break
        following = farther
    number = np.cumsum(following[:n] == np.arange(n)) - 1
    return number[following[:n]], number[following[n:]]


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order of the groups, with their numbers of tokens."""
    key, count = np.unique(group.astype(np.int64) << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count


def pairs(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, bits: int):
    """(group, pair, links) of the distinct id pairs of every group; a pair is ``a << bits | b``.

    Ids that repeat within a group are counted before they are paired, so a long run of one token makes no product.
    """
    ga, a, na = _counted(group_a, ids_a)
    gb, b, nb = _counted(group_b, ids_b)
    per_group = np.bincount(gb, minlength=int(ga[-1]) + 1 if len(ga) else 0)
    first = np.cumsum(per_group) - per_group
    width = per_group[ga]
    left = np.repeat(np.arange(len(ga)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[ga], width)
    return ga[left], a[left] << bits | b[right], na[left] * nb[right]


class Aligned(NamedTuple):
    """Aligned chunks one after another: groups as text, (tokens a, tokens b, groups), whether a side changes the bytes, and
    the pairs and links from ``first[k]`` to ``first[k + 1]``."""

    text: list[bytes]
    sizes: np.ndarray
    bad: np.ndarray
    first: np.ndarray
    pair: np.ndarray
    links: np.ndarray


class Sides:
    """Both tokenizers on chunks: a word stands for the word after a space, ``\\n`` and a word for themselves, ``\\x01`` and
    some text for that text alone."""

    def __init__(self, name_a: str, name_b: str):
        import sentencepiece

        self.a = Encoder(public_path(name_a))
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_path(name_b))
        letters = {c: b for b, c in _byte_letters().items()}
        vocabulary = sorted((i, t) for t, i in self.a.library.get_vocab().items())
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for _, t in vocabulary]
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Marks can be cut off a word where no piece holds a letter and a mark behind it.
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts_marks = not any(MARK.search(p) for p in plain)
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # An id in decimal and what follows it: another one of its side, the other side, or the next group.
        self.names = [b"%d%s" % (i, mark) for n, marks in ((len(self.bytes_a), (b",", b"|")), (size, (b",", b";"))) for mark in marks for i in range(n)]
        self.name_length = np.array([len(x) for x in self.names], np.int64)
        self.bits = max(1, (size - 1).bit_length())

    def _ids_a(self, chunk: str) -> bytes:
        if chunk[0] == "\n":
            return self.a.line_end + self.a._chunk(chunk[1:])
        if chunk[0] == ALONE:
            return self.a._library(chunk[1:])
        return self.a._letters(chunk, SPACE) if LETTERS.fullmatch(chunk) else self.a._library(" " + chunk)

    def align(self, chunks: list[str], whole: bool = False) -> Aligned:
        """Align chunks, or with ``whole`` one text."""
        if whole:
            found_a, sent, told = [self.a._library(" " + t) for t in chunks], chunks, [f" {t}" for t in chunks]
            cut = np.zeros(len(chunks), np.int64)
        else:
            found_a = list(map(self._ids_a, chunks))
            sent = ["\n" + c[1:] if c[0] == ALONE else c for c in chunks]
            told = [c[1:] if c[0] == ALONE else c if c[0] == "\n" else " " + c for c in chunks]
            # A line end keeps the space that the library puts in front apart from what follows.
            cut = np.array([2 if c[0] == ALONE else 1 if c[0] == "\n" else 0 for c in chunks], np.int64)
        told = [t.encode("utf-8", "surrogatepass") for t in told]
        size_a = np.array([len(x) // 4 for x in found_a], np.int64)
        a = np.frombuffer(b"".join(found_a), np.uint32).astype(np.int64)
        found_b = self.b.encode(sent, num_threads=1)
        size_b = np.array([len(x) for x in found_b], np.int64)
        b = np.fromiter(itertools.chain.from_iterable(found_b), np.int64, int(size_b.sum()))
        if cut.any():
            keep = np.ones(len(b), bool)
            starts = np.cumsum(size_b) - size_b
            keep[starts[cut > 0]] = False
            keep[starts[cut > 1] + 1] = False
            b, size_b = b[keep], size_b - cut
        bad = self._bad(a, size_a, b, size_b, told)
        if bad.any():
            return self._scattered(chunks, bad, whole)
        group_a, group_b = labels(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        # A chunk's end is a common end, so its groups are those up to its last token's.
        last = group_a[np.cumsum(size_a) - 1] + 1
        group, pair, links = pairs(group_a, a, group_b, b, self.bits)
        return Aligned(
            self._texts(a, group_a, b, group_b, last), np.stack([size_a, size_b, np.diff(last, prepend=0)], axis=1), bad,
            np.concatenate([[0], np.searchsorted(group, last)]), pair, links)

    def _bad(self, a, size_a, b, size_b, told: list[bytes]) -> np.ndarray:
        """Which chunks a side does not give back byte for byte."""
        length = np.array([len(t) for t in told], np.int64)
        whole, bad = b"".join(told), np.zeros(len(told), bool)
        for ids, size, lengths, names in ((a, size_a, self.length_a, self.bytes_a), (b, size_b, self.length_b, self.bytes_b)):
            given = b"".join(map(names.__getitem__, ids.tolist()))
            if given != whole:
                ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.cumsum(size)].tolist()
                bad |= [given[s:e] != t for s, e, t in zip([0, *ends], ends, told, strict=False)]
        return bad

    def _scattered(self, chunks: list[str], bad: np.ndarray, whole: bool) -> Aligned:
        good = np.flatnonzero(~bad)
        if not len(good):
            none = np.empty(0, np.int64)
            return Aligned([b""] * len(chunks), np.zeros((len(chunks), 3), np.int64), bad, np.zeros(len(chunks) + 1, np.int64), none, none)
        part = self.align([chunks[k] for k in good.tolist()], whole)
        text, sizes, width = [b""] * len(chunks), np.zeros((len(chunks), 3), np.int64), np.zeros(len(chunks), np.int64)
        sizes[good], width[good] = part.sizes, np.diff(part.first)
        for k, t in zip(good.tolist(), part.text, strict=True):
            text[k] = t
        return Aligned(text, sizes, bad, np.concatenate([[0], np.cumsum(width)]), part.pair, part.links)

    def _texts(self, a, group_a, b, group_b, last: np.ndarray) -> list[bytes]:
        """Per chunk its groups, each with a mark behind it. A token's place follows from the tokens of the groups before."""
        total = int(last[-1]) if len(last) else 0
        end_a, end_b = (np.searchsorted(g, np.arange(total), "right") for g in (group_a, group_b))
        place_a = np.arange(len(a)) + np.concatenate([[0], end_b])[group_a]
        place_b = np.arange(len(b)) + end_a[group_b]
        final_a, final_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        final_a[end_a - 1] = final_b[end_b - 1] = 1
        name = np.empty(len(a) + len(b), np.int64)
        name[place_a] = a + final_a * len(self.bytes_a)
        name[place_b] = b + final_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        blob = b"".join(map(self.names.__getitem__, name.tolist()))
        ends = np.cumsum(self.name_length[name])[(end_a + end_b)[last - 1] - 1].tolist()
        return [blob[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write every byte as one printable character."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Aligner:
    """Documents from their chunks; aligned chunks are kept, up to ``CACHE`` of them, in flat arrays."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []
        self.held = 0
        self.sizes = np.zeros((CACHE, 3), np.int64)
        self.bad = np.zeros(CACHE, bool)
        self.first = np.zeros(CACHE + 1, np.int64)
        self.pair, self.links = np.zeros(1 << 20, np.int64), np.zeros(1 << 20, np.int64)

    def _keep(self, chunks: list[str]) -> None:
        new, at = self.sides.align(chunks), len(self.text)
        to = at + len(chunks)
        self.number.update(zip(chunks, range(at, to), strict=True))
        self.text += new.text
        self.held += sum(map(len, new.text))
        self.sizes[at:to], self.bad[at:to] = new.sizes, new.bad
        begin, end = self.first[at], self.first[at] + len(new.pair)
        while end > len(self.pair):
            self.pair, self.links = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pair, self.links))
        self.pair[begin:end], self.links[begin:end], self.first[at + 1 : to + 1] = new.pair, new.links, begin + new.first[1:]

    def chunks(self, text: str) -> list[str] | None:
        """The text cut where both sides do, or None where its white space may be more than a cut."""
        if ALONE in text or odd(text):
            return None
        if self.sides.cuts_marks:
            text = MARK.sub(rf" {ALONE}\1", text)
        return text.replace("\n", " \n").split(" ")

    def documents(self, texts: list[str | None]):
        """Per text: (digest of the groups, tokens a, tokens b, groups, pairs, links)."""
        at = 0
        while at < len(texts):
            taken, held, new = [], 0, set()
            while at < len(texts) and (not taken or held < TURN):
                text = texts[at]
                at += 1
                chunks = self.chunks(text) if text else None
                if chunks:
                    held += len(chunks)
                    new.update(chunks)
                taken.append((text, chunks))
            listed = [c for c in new if c not in self.number]
            if len(self.text) + len(listed) > CACHE or self.held > HELD:
                self.clear()
                listed = list(new)
            if len(listed) > CACHE:
                # One text with more different words than are kept: it is aligned as one chunk.
                taken, listed = [(t, None) for t, _ in taken], []
            for k in range(0, len(listed), 8192):
                self._keep(listed[k : k + 8192])
            yield from self._join(taken)

    def _join(self, taken):
        known = [np.fromiter(map(self.number.__getitem__, c), np.int64, len(c)) for _, c in taken if c]
        joined = iter(self._linked(known))
        for text, chunks in taken:
            if chunks:
                yield next(joined)
            elif text:
                yield self._whole(text)
            else:
                yield NOTHING

    def _whole(self, text: str) -> tuple:
        found = self.sides.align([text], whole=True)
        if found.bad[0]:
            return NOTHING
        distinct, place = np.unique(found.pair, return_inverse=True)
        links = np.zeros(len(distinct), np.int64)
        np.add.at(links, place, found.links)
        return hashlib.sha256(found.text[0][:-1]).hexdigest(), *found.sizes[0].tolist(), distinct, links

    def _linked(self, known: list[np.ndarray]):
        if not known:
            return
        starts = np.cumsum([0, *map(len, known)])
        place = np.concatenate(known)
        sizes = np.add.reduceat(self.sizes[place], starts[:-1], axis=0).tolist()
        bad = np.logical_or.reduceat(self.bad[place], starts[:-1]).tolist()
        # A word that a document repeats is expanded to its pairs once.
        key, times = np.unique(np.repeat(np.arange(len(known)), np.diff(starts)) << 32 | place, return_counts=True)
        doc, word = key >> 32, key & 0xFFFFFFFF
        width = self.first[word + 1] - self.first[word]
        at = np.arange(int(width.sum())) + np.repeat(self.first[word] - (np.cumsum(width) - width), width)
        key, links = np.repeat(doc, width) << 44 | self.pair[at], self.links[at] * np.repeat(times, width)
        order = np.argsort(key)
        key, links = key[order], links[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        key, links = key[begin], np.add.reduceat(links, begin) if len(begin) else links
        cuts = np.searchsorted(key, np.arange(len(known) + 1) << 44).tolist()
        pair = key & ((1 << 44) - 1)
        for k, own in enumerate(known):
            if bad[k]:
                yield NOTHING
                continue
            digest = hashlib.sha256(b"".join(map(self.text.__getitem__, own.tolist()))[:-1]).hexdigest()
            yield digest, *sizes[k], pair[cuts[k] : cuts[k + 1]], links[cuts[k] : cuts[k + 1]]


NOTHING = ("", 0, 0, 0, np.empty(0, np.int64), np.empty(0, np.int64))


@functools.lru_cache(maxsize=1)
def aligner(name_a: str, name_b: str) -> Aligner:
    """One per worker process."""
    hold("alignment", aligner.cache_clear)
    return Aligner(Sides(name_a, name_b))


ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary")


def aligned(docs: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Per document its sizes, digest, and distinct pairs with their links (64-bit integers), stored once."""

    def run(batches):
        only("alignment")
        align = aligner(name_a, name_b)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(align.documents(part.column("text").to_pylist()))
                digest, na, nb, groups, pair, links = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("doc_id"), pa.array(na, pa.int64()), pa.array(nb, pa.int64()),
                    pa.array(groups, pa.int64()), pa.array([int(x.sum()) for x in links], pa.int64()), pa.array(digest, pa.string()),
                    pa.array([packed(x) for x in pair], pa.binary()), pa.array([packed(x) for x in links], pa.binary())],
                    [c.split()[0] for c in ALIGNED.split(", ")])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store(plain.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, ALIGNED), "aligned")


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in 1, 4 or 8 bytes each; the first byte says which."""
    top = int(values.max()) if len(values) else 0
    size = 1 if top < 1 << 8 else 4 if top < 1 << 32 else 8
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, f"<u{held[0]}", offset=1).astype(np.int64)


def pair_counts(stored: DataFrame, bits: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether n is the highest of its first id)."""

    def count(batches):
        only()
        held, size = [], 0

        def flush():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["pair", "n"])

        for batch in batches:
            for packed_pairs in batch.column(0):
                held.append(unpacked(packed_pairs.as_py()))
                size += len(held[-1])
                if size > 1 << 22:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counted = stored.where("n_links > 0").select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = store(counted.withColumn("first_id", F.shiftright("pair", bits)), "pair-counts")
    highest = counted.groupBy("first_id").agg(F.max("n").alias("highest"))
    return store(counted.join(highest, "first_id").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-ranks")


@functools.lru_cache(maxsize=1)
def _lookup(paths: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Counts from the shared folder, in order of the pairs."""
    hold("pair-counts", _lookup.cache_clear)
    parts = []
    for path in paths:
        filesystem, name = pafs.FileSystem.from_uri(path)
        parts.append(pq.read_table(name, filesystem=filesystem))
    whole = pa.concat_tables(parts)
    pair, n, best = (whole.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order]


def _by_lookup(stored: DataFrame, ranked: DataFrame) -> DataFrame:
    """row, n_best, count_sum; every task reads the counts."""
    paths = tuple(sorted(ranked.inputFiles()))

    def run(batches):
        only("pair-counts")
        known, n, best = _lookup(paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pair, links = ([unpacked(x.as_py()) for x in part.column(c)] for c in ("pairs", "links"))
                ends = np.cumsum([0, *map(len, pair)])
                place, links = np.searchsorted(known, np.concatenate(pair)), np.concatenate(links)
                totals = [np.concatenate([[0], np.cumsum(x)]) for x in (links * best[place], links * n[place])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), *(pa.array(np.diff(t[ends]).astype(np.int64)) for t in totals)], ["row", "n_best", "count_sum"])

    return stored.where("n_links > 0").select("row", "pairs", "links").mapInArrow(run, "row long, n_best long, count_sum long")


def _by_join(stored: DataFrame, ranked: DataFrame) -> DataFrame:
    """The same by a join on the pair, for any number of pairs."""

    def unpack(batches):
        for batch in batches:
            for row, pair, links in zip(*(batch.column(k) for k in range(3)), strict=True):
                found = unpacked(pair.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), row.as_py())), pa.array(found), pa.array(unpacked(links.as_py()))], ["row", "pair", "links"])

    single = stored.where("n_links > 0").select("row", "pairs", "links").mapInArrow(unpack, "row long, pair long, links long")
    return single.join(ranked, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))


def alignment(docs: DataFrame, name_a: str, name_b: str, lookup: int = LOOKUP) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    stored = aligned(docs, name_a, name_b)
    ranked = pair_counts(stored, Sides(name_a, name_b).bits)
    known = ranked.count()
    # Without any pair the join is over no rows; the look-up has no files then.
    totals = _by_lookup(stored, ranked) if 0 < known <= lookup else _by_join(stored, ranked)
    none = F.lit(0).cast("long")
    return stored.join(totals, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def spans(docs: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Per document: doc_id and its groups as (start, end, ids_a, ids_b), offsets in bytes of a space and the text."""
    kind = "doc_id long, groups array<struct<start: long, end: long, ids_a: array<int>, ids_b: array<int>>>"

    def run(batches):
        only("alignment")
        sides = aligner(name_a, name_b).sides
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = sides.align([text], whole=True) if text else None
                groups, at = [], 0
                for group in found.text[0][:-1].split(b";") if found and not found.bad[0] else []:
                    ids_a, ids_b = ([int(i) for i in side.split(b",")] for side in group.split(b"|"))
                    end = at + int(sides.length_a[ids_a].sum())
                    groups.append({"start": at, "end": end, "ids_a": ids_a, "ids_b": ids_b})
                    at = end
                rows.append(groups)
            group = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ids_a", pa.list_(pa.int32())), ("ids_b", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(group))], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)
