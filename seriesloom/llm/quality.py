"""Quality: regularised quadratic discriminant over transformed document statistics.

Each document gives ``STATISTICS``, counts and shares of its whole text on log and log-odds scales. Both classes
are Gaussian with their own means and covariances. A covariance is shrunk towards its diagonal, and its
diagonal towards the pooled variances, so that a thin class stays invertible; the Cholesky factors are
computed once and shared. The score is the logistic link of the log-density difference plus the
log prior odds.

Means and covariances come from sums over all labelled training rows, added up on the executors: the
driver sees one number per class and pair of statistics, however many rows there are.

Null and empty texts have defined statistics (all counts zero) and are scored like any other. Documents without
a label are only scored, as are those with a NULL doc_id, which are in no fold (held_out is false); where a doc_id is labelled twice and the rows disagree, 1 wins. Repeated
documents are scored one by one. With fewer than two rows of a class the score is the smoothed share
of class 1. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.classify import clean_labels, sigmoid
from seriesloom.llm.common import in_fold, only
from seriesloom.session import store

THRESHOLD = 0.7

STATISTICS = (
    "log_words", "log_word_length", "letters", "capitals", "marks", "digits", "bars", "odd_marks", "ends_marked",
    "distinct", "top_share", "repeats", "log_sentence", "log_lines", "short_words", "log_packed",
)

_KINDS = np.zeros(256, np.int64)  # 0 other
_KINDS[[*range(97, 123), *range(128, 256)]] = 1  # lower-case and non-ASCII letters, by bytes
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_KINDS[[9, 10, 13, 32]] = 4
for _c in b".,;:'\"()-!?":
    _KINDS[_c] = 5
for _c in b"|#$%&*+/<=>@[]^_`{}~\\":
    _KINDS[_c] = 6


def _odds(part: float, whole: float) -> float:
    share = (part + 0.5) / (whole + 1.0)
    return float(np.log(share / max(1.0 - share, 1e-9)))


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, all finite."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=7)
    found = text.split() if text else []
    count, solid = len(found), len(raw) - int(kinds[4])
    counts = Counter(found)
    top = max(counts.values(), default=0)
    repeats = sum(map(str.__eq__, found, found[1:])) if count > 1 else 0
    endings = sum(raw.count(c) for c in (b".", b"!", b"?"))
    marked = sum(1 for w in found if w[-1] in "#$%&*!|")
    return [
        float(np.log1p(count)), float(np.log((solid + 1) / (count + 1))),
        _odds(kinds[1] + kinds[2], solid), _odds(kinds[2], solid), _odds(kinds[5], solid), _odds(kinds[3], solid),
        _odds(raw.count(b"|"), count), _odds(kinds[6], solid), _odds(marked, count),
        _odds(len(counts), count), _odds(top, count), _odds(repeats, count),
        float(np.log((count + 1) / (endings + 1))), float(np.log((count + 1) / (raw.count(b"\n") + 1))),
        _odds(sum(1 for w in found if len(w) <= 3), count),
        float(np.log((len(zlib.compress(raw, 1)) + 20) / (len(raw) + 20))),
    ]


class QualityModel(NamedTuple):
    """Means, inverse Cholesky factors and log determinants of both classes; None where a class is missing."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_prior: float
    ready: bool

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready or not len(x):
            return np.full(len(x), float(sigmoid(self.log_prior)))
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(-0.5 * ((z**2).sum(axis=1) + self.log_dets[k]))
        return sigmoid(density[1] - density[0] + self.log_prior)


def from_moments(n: np.ndarray, sums: np.ndarray, products: np.ndarray, to_diagonal: float = 0.1,
                 to_pooled: float = 0.05) -> QualityModel:
    """The model from both classes' row counts, sums and sums of products."""
    log_prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    size = sums.shape[1]
    empty = QualityModel(np.zeros((2, size)), np.zeros((2, size, size)), np.zeros(2), log_prior, False)
    if n.min() < 2:
        return empty
    means = sums / n[:, None]
    covariances = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (covariances * (n / n.sum())[:, None, None]).sum(axis=0).diagonal() + 1e-4
    factors, dets = [], []
    for c in covariances:
        diagonal = (1 - to_pooled) * np.maximum(c.diagonal(), 0) + to_pooled * pooled
        shrunk = (1 - to_diagonal) * c
        shrunk[np.arange(size), np.arange(size)] = diagonal
        lower = np.linalg.cholesky(shrunk + 1e-9 * np.eye(size))
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(lower.diagonal()).sum())
    return QualityModel(means, np.array(factors), np.array(dets), log_prior, True)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every document: small rows, so that labels are joined to them and not to the texts."""

    def measure(batches):
        only()
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")], float).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))],
                ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measure, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def train(rows: DataFrame, labels: DataFrame) -> QualityModel:
    """Sum the moments of all labelled documents given (the caller leaves out held-out rows); ``rows`` as ``measured`` gives them."""
    size = len(STATISTICS)
    width = 1 + size + size * size

    def moments(batches):
        for batch in batches:
            y, x = batch.column("y").to_numpy(), _matrix(batch.column("x"))
            for label in (0, 1):
                own = x[y == label]
                values = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(width, label, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(values)],
                    ["y", "at", "value"])

    known = clean_labels(labels, "quality")
    sums = rows.join(known, "doc_id").select("y", "x").mapInArrow(moments, "y int, at int, value double").groupBy("y", "at").agg(
        F.sum("value").alias("value"))
    totals = np.zeros((2, width))
    for y, at, value in sums.collect():  # at most 2 * width rows
        totals[y, at] = value
    return from_moments(totals[:, 0], totals[:, 1 : 1 + size], totals[:, 1 + size :].reshape(2, size, size))


def quality(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, score all documents. Each text is read once."""
    rows = store(measured(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels.where(~in_fold(F.col("doc_id"), parts, held))))

    def rate(batches):
        for batch in batches:
            scores = shared.value.scores(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(rate, "doc_id long, score double, predicted int")
    return scored.select("doc_id", in_fold(F.col("doc_id"), parts, held).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their columns. All labelled rows are learnt from.

    The texts are read twice, once for the moments and once for the decision, and never shuffled. The statistics are
    stored in between: in one stage with the moments each task would keep two Python workers, which live on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(store(measured(docs), "statistics"), labels))

    def accept(batches):
        only()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            x = np.array([statistics(t.as_py()) for t in texts], float).reshape(batch.num_rows, len(STATISTICS))
            yield batch.filter(pa.array(shared.value.scores(x) >= threshold, pa.bool_()))

    return docs.mapInArrow(accept, docs.schema)
