"""Language-model scores from a subword lattice: the marginal probability over all segmentations.

A text is its words (A-Z in lower case, cut at ASCII white space) and an end. Every word is spelt by paths through a
lattice: each path is a sequence of pieces of an existing public vocabulary that spell it, and, for words of the
training texts, one arc over the whole word. All paths count: a log-space forward recursion adds them up, so no single
segmentation is chosen. Pieces that begin a word and pieces inside a word are two distributions, the latter with a stop;
characters that are no piece are spelt by the vocabulary's byte pieces. Whole-word arcs have the discounted relative
frequency (c - D) / N, and what the discount frees, D * V / N, goes to the pieces.

The public vocabulary's own scores are merge ranks, not probabilities, so they only decide, with the library, how each
distinct training word is cut for counting pieces; no tokenizer is trained. Each language of the training texts
(those with ``SHARE`` of the tokens or more; the rest together) has its own scores. A text's language is
not given to the model: its probability is the sum over languages of the language's share times the text's probability.

Counts cover all training documents. The ``HEAD`` most frequent words' scores go to every task (a fixed number of rows);
all other words are joined, so nothing depends on how many words there are. One task's documents are
counted before they are shuffled; a word of a third of all rows moves once per task.

Null texts count as empty: the end alone. Repeated documents are scored, and learnt from, row by row. Rows of NULL doc_id
are never learnt from but scored. A null language is one of its own. Without training rows, known counts are zero and all pieces
are equally likely. Extra columns are ignored; an empty table gives no rows.
A NULL doc_id is in no fold: held_out is false, and the text is learnt from.
"""

from __future__ import annotations

import functools
import math
import os
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import in_fold, mix
from seriesloom.llm.tokens import public_path
from seriesloom.session import store

DISCOUNT = 0.75
HEAD = 250_000
SHARE = 0.01
FLUSH = 250_000
END = b"\n"  # never a word, as it is white space
SPACE = "▁"
SHORT = 48
SMOOTH = 0.02


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@functools.lru_cache(2)
def _vocabulary(name: str):
    """Pieces by text, byte pieces by byte, the library's processor; one per worker process."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=name if os.path.sep in name else public_path(name))
    pieces, by_byte = {}, np.zeros(256, np.int64)
    for k in range(library.get_piece_size()):
        if library.is_byte(k):
            by_byte[int(library.id_to_piece(k)[3:5], 16)] = k
        elif not (library.is_control(k) or library.is_unknown(k) or library.is_unused(k)):
            piece = library.id_to_piece(k)
            if SPACE not in piece[1:]:
                pieces[piece] = k
    return pieces, by_byte, library


class Scores(NamedTuple):
    """Natural logarithms by language (rows) and piece (columns), of stopping, and of each language's share."""

    pieces: np.ndarray
    stop: np.ndarray
    share: np.ndarray
    n: np.ndarray  # training tokens by language
    v: np.ndarray  # distinct ones


class Lattice:
    """Forward recursion over words for all languages at once."""

    def __init__(self, name: str, scores: Scores):
        self.by_text, self.by_byte, _ = _vocabulary(name)
        self.scores, self.longest = scores, max(map(len, self.by_text))
        hashes = np.array([self._hash(p) for p in self.by_text], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(self.by_text.values()), np.int64)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(mix(self.hashes) >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _spelt(self, character: str) -> np.ndarray:
        """A character as byte pieces."""
        return self.scores.pieces[:, self.by_byte[list(character.encode("utf-8", "surrogatepass"))]].sum(axis=1)

    def one(self, word: str) -> np.ndarray:
        """Log probability of one word by language; any length."""
        text = SPACE + word
        ahead = np.full((len(text) + 1, len(self.scores.stop)), -np.inf)
        ahead[0] = 0.0
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                if start and text[start] == SPACE:
                    continue
                piece = self.by_text.get(text[start:end])
                if piece is not None:
                    ahead[end] = np.logaddexp(ahead[end], ahead[start] + self.scores.pieces[:, piece])
            if text[end - 1] not in self.by_text or end > 1 and text[end - 1] == SPACE:
                ahead[end] = np.logaddexp(ahead[end], ahead[end - 1] + self._spelt(text[end - 1]))
        return ahead[-1] + self.scores.stop

    def many(self, words: list[str]) -> np.ndarray:
        """Log probabilities, words x languages. Words of equal length are run together."""
        out = np.empty((len(words), len(self.scores.stop)))
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > SHORT or SPACE in word:
                out[k] = self.one(word)
            else:
                groups.setdefault(len(word), []).append(k)
        for length, rows in groups.items():
            text = "".join(words[k] for k in rows)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), length)
            out[rows] = self._run(np.concatenate([np.full((len(rows), 1), ord(SPACE), np.uint32), codes], axis=1))
        return out

    def _run(self, codes: np.ndarray) -> np.ndarray:
        count, length = codes.shape
        values = codes.astype(np.uint64) + np.uint64(1)
        arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
        h = np.zeros((count, length + 1), np.uint64)
        covered = np.zeros((count, length), bool)
        with np.errstate(over="ignore"):
            for size in range(1, min(self.longest, length) + 1):
                h = h[:, : length - size + 1] * np.uint64(0x9E3779B97F4A7C15) + values[:, size - 1 :]
                rows, starts = np.nonzero(self.marks[(mix(h) >> np.uint64(44)).astype(np.int64)])
                seen = h[rows, starts]
                at = np.minimum(np.searchsorted(self.hashes, seen), len(self.hashes) - 1)
                hit = self.hashes[at] == seen
                rows, starts, found = rows[hit], starts[hit], self.ids[at[hit]]
                if size == 1:
                    covered[rows, starts] = True
                order = np.argsort(starts, kind="stable")
                rows, starts, found = rows[order], starts[order], found[order]
                cuts = np.flatnonzero(np.diff(starts)) + 1
                edges = np.concatenate([[0], cuts, [len(starts)]])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if b > a:
                        start = int(starts[a])
                        arcs[start + size].append((start, rows[a:b], found[a:b]))
        scores = self.scores.pieces.T  # pieces x languages
        ahead = np.full((length + 1, count, scores.shape[1]), -np.inf)
        ahead[0] = 0.0
        spelt: dict[int, np.ndarray] = {}
        for end in range(1, length + 1):
            for start, rows, ids in arcs[end]:
                ahead[end][rows] = np.logaddexp(ahead[end][rows], ahead[start][rows] + scores[ids])
            for row in np.flatnonzero(~covered[:, end - 1]).tolist():
                code = int(codes[row, end - 1])
                if code not in spelt:
                    spelt[code] = self._spelt(chr(code))
                ahead[end][row] = np.logaddexp(ahead[end][row], ahead[end - 1][row] + spelt[code])
        return ahead[-1] + self.scores.stop

    def words(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """log10 probabilities of words given their training counts by language (words x languages)."""
        s = self.scores
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - DISCOUNT, 0)) - np.log(np.maximum(s.n, 1))
            freed = np.where(s.n > 0, np.log(DISCOUNT * np.maximum(s.v, 1) / np.maximum(s.n, 1)), 0.0)
        total = np.logaddexp(whole, np.minimum(freed, 0.0) + self.many(words))
        end = END.decode()
        for k, word in enumerate(words):
            if word == end:
                total[k] = np.log(np.maximum(counts[k], 0.5)) - np.log(np.maximum(s.n, 1))
        return total / math.log(10)


def piece_scores(counts: np.ndarray, stops: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of pieces and of stopping, from piece counts (languages x pieces) and word counts."""
    pieces, by_byte, _ = _vocabulary(name)
    first = np.array(sorted(k for p, k in pieces.items() if p[0] == SPACE), np.int64)
    inner = np.concatenate([np.array(sorted(k for p, k in pieces.items() if p[0] != SPACE), np.int64), by_byte])
    out = np.full(counts.shape, -np.inf)
    smooth = counts + SMOOTH
    out[:, first] = np.log(smooth[:, first] / smooth[:, first].sum(axis=1, keepdims=True))
    whole = smooth[:, inner].sum(axis=1) + stops + SMOOTH
    out[:, inner] = np.log(smooth[:, inner] / whole[:, None])
    return out, np.log((stops + SMOOTH) / whole)


def count_words(docs: DataFrame) -> DataFrame:
    """word, lang, n_train, n_all; needs the columns text, lang and train."""

    def count(batches):
        sums: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for text, lang, train in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("train").to_pylist(), strict=True):
                own = sums.setdefault((lang, 1 if train else 0), Counter())
                own.update(tokens(text.as_py()))
                own[END] += 1
                if sum(map(len, sums.values())) >= FLUSH:
                    yield _rows(sums)
                    sums = {}
        if sums:
            yield _rows(sums)

    def _rows(sums):
        parts = []
        for (lang, train), own in sums.items():
            n = np.fromiter(own.values(), np.int64, len(own))
            parts.append(pa.RecordBatch.from_arrays(
                [pa.array(list(own), pa.binary()).cast(pa.string()), pa.array([lang] * len(own), pa.string()), pa.array(n * train), pa.array(n)],
                ["word", "lang", "n_train", "n_all"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    counted = docs.select("text", "lang", "train").mapInArrow(count, "word string, lang string, n_train long, n_all long")
    return counted.groupBy("word", "lang").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def score(docs: DataFrame, train: F.Column, vocabulary: str = "piece_bpe_32k.model", head: int = HEAD) -> DataFrame:
    """Per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score. ``train`` marks the rows to learn from."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                         F.coalesce(train, F.lit(False)).alias("train"))
    counted = store(count_words(source), "counts")
    by_lang = counted.groupBy("lang").agg(F.sum("n_train").alias("n")).where("n > 0")
    total = by_lang.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Each has at least SHARE of the tokens, so there are at most 1 / SHARE of them.
    main = sorted(r["lang"] for r in by_lang.where(F.col("n") >= SHARE * total).collect())
    size = len(main) + 1  # the last holds all other languages
    place = F.lit(len(main))
    for k, lang in enumerate(main):
        place = F.when(F.col("lang") == lang, k).otherwise(place)
    words = store(counted.withColumn("k", place).groupBy("word").agg(
        F.sum("n_train").alias("c"), F.sum("n_all").alias("n_all"),
        F.array(*[F.sum(F.when(F.col("k") == k, F.col("n_train")).otherwise(0)) for k in range(size)]).alias("by_lang")), "words")
    sums = words.agg(
        F.count(F.when(F.col("c") > 0, 1)).alias("v"),
        *[F.coalesce(F.sum(F.col("by_lang")[k]), F.lit(0)).alias(f"n{k}") for k in range(size)],
        *[F.count(F.when(F.col("by_lang")[k] > 0, 1)).alias(f"v{k}") for k in range(size)]).first()
    ends = words.where(F.col("word") == END.decode()).select("by_lang").first()
    n, v = (np.array([sums[f"{x}{k}"] for k in range(size)], float) for x in ("n", "v"))
    ends = np.array(ends[0], float) if ends else np.zeros(size)

    def cut(batches):
        _, _, library = _vocabulary(vocabulary)
        for batch in batches:
            known = np.array(batch.column("by_lang").to_pylist()) > 0
            lengths, flat = [], []
            for ids in library.encode(batch.column("word").to_pylist()):
                lengths.append(len(ids))
                flat += ids
            flat, row = np.array(flat, np.int64), np.repeat(np.arange(len(lengths)), lengths)
            for k in np.flatnonzero(known.any(axis=0)).tolist():
                ids, counts = np.unique(flat[known[row, k]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k, np.int32)), pa.array(ids), pa.array(counts)], ["k", "piece", "n"])

    pieces = np.zeros((size, _vocabulary(vocabulary)[2].get_piece_size()))
    # Bounded by languages x vocabulary.
    for k, piece, count in words.where((F.col("c") > 0) & (F.col("word") != END.decode())).mapInArrow(
            cut, "k int, piece long, n long").groupBy("k", "piece").agg(F.sum("n")).collect():
        pieces[k, piece] = count
    table, stop = piece_scores(pieces, np.maximum(v - (ends > 0), 0), vocabulary)
    share = (ends + 1e-3) / (ends + 1e-3).sum()
    model = spark.sparkContext.broadcast(Scores(table, stop, np.log10(share), n, v))
    train_tokens, distinct = int(n.sum()), int(sums["v"])
    denominator = train_tokens + distinct + 1

    def weigh(batches):
        lattice = Lattice(vocabulary, model.value)
        for batch in batches:
            found = lattice.words(batch.column("word").to_pylist(), np.array(batch.column("by_lang").to_pylist(), float).reshape(batch.num_rows, size))
            c = batch.column("c").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(c > 0), pa.array(np.log10((c + 1) / denominator)),
                 pa.FixedSizeListArray.from_arrays(pa.array(found.astype(np.float32).ravel()), size).cast(pa.list_(pa.float32()))],
                ["word", "known", "base", "logs"])

    weighed = "word string, known boolean, base double, logs array<float>"
    top = words.orderBy(F.desc("n_all"), "word").limit(head).mapInArrow(weigh, weighed).toArrow()
    frequent = spark.sparkContext.broadcast((
        top.column("word").to_pylist(), np.concatenate([
            top.column("known").to_numpy()[:, None].astype(float), top.column("base").to_numpy()[:, None],
            np.array(top.column("logs").combine_chunks().values).reshape(-1, size)], axis=1) if top.num_rows else np.zeros((0, size + 2))))

    def first_pass(batches):
        names, values = frequent.value
        at = {w.encode(): k for k, w in enumerate(names)}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, sums, tails, counts, sizes = [], [], [], [], []
            for text in batch.column("text"):
                own = Counter(tokens(text.as_py()))
                own[END] += 1
                place = np.fromiter((at.get(w, -1) for w in own), np.int64, len(own))
                n = np.fromiter(own.values(), np.int64, len(own))
                here = place >= 0
                sums.append(n[here] @ values[place[here]])
                sizes.append(int(n.sum()))
                tails.append([w for w, p in zip(own, here.tolist(), strict=True) if not p])
                counts.append(n[~here].astype(np.int32))
                rows.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column("doc_id"), batch.column("train"), pa.array(sizes, pa.int64()),
                 pa.array([s.tolist() for s in sums], pa.list_(pa.float64())),
                 pa.array(tails, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))],
                ["row", "doc_id", "train", "n_tokens", "sums", "words", "counts"])

    passed = store(source.select("doc_id", "train", "text").mapInArrow(
        first_pass, "row long, doc_id long, train boolean, n_tokens long, sums array<double>, words array<string>, counts array<int>"), "passed")
    tail = passed.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "counts")).alias("z")).select(
        "row", F.col("z.words").alias("word"), F.col("z.counts").alias("n"))
    rare = tail.join(words.mapInArrow(weigh, weighed), "word").groupBy("row").agg(
        F.sum(F.col("n") * F.col("known").cast("int")).alias("known"), F.sum(F.col("n") * F.col("base")).alias("base"),
        *[F.sum(F.col("n") * F.col("logs")[k]).alias(f"l{k}") for k in range(size)])
    joined = passed.select("row", "doc_id", "train", "n_tokens", "sums").join(rare, "row", "left")
    logs = [F.col("sums")[k + 2] + F.coalesce(F.col(f"l{k}"), F.lit(0.0)) + F.lit(float(np.log10(share[k]))) for k in range(size)]
    most = F.greatest(*logs) if size > 1 else logs[0]
    spread = functools.reduce(lambda a, b: a + b, [F.pow(F.lit(10.0), x - F.col("most")) for x in logs])
    return joined.withColumn("most", most).select(
        "doc_id", "train", "n_tokens", (F.col("sums")[0] + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("sums")[1] + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("most") + F.log10(spread)).alias("score"))


def held_out_scores(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """Learn outside the held-out fold, score all documents."""
    scored = score(docs, ~in_fold(F.col("doc_id"), parts, held))
    return scored.select("doc_id", in_fold(F.col("doc_id"), parts, held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
