"""Toxicity: a word classifier whose score must not change when identity terms are swapped.

Logistic regression over presence features: each distinct word, its prefixes of four to seven letters,
and for prefixes also whether two or four distinct words share it (insults are built on stems). The ``kept``
features with the strongest association (G squared) in the sample are used. Each labelled sentence that
names a group also gives counterfactual copies in which the term is replaced by the others of its
family, or taken out; the squared difference of the scores is added to the loss (weight ``penalty``). The
score is linear, so that is a quadratic form in the weights, and the fit stays a Newton iteration. It
pulls the effect of a family's terms together and towards none: a plain mention of a group does not
raise the score.

The training sample is bounded: ``per_class`` labelled documents of each class, chosen by hash. The
features are counted on the executors; the driver gets the sample's selected features only. All
documents are scored whole.

Null and empty texts get the score of the intercept. Documents without a label are only scored. Where a doc_id
is labelled twice and the rows disagree, 1 wins. Repeated documents are scored one by one. With no
labelled rows, or only one class, the score is the smoothed share of that class. Extra columns are
ignored.
A NULL doc_id is in no fold (held_out is false) and has no label.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.classify import bounded_sample, clean_labels, sigmoid
from seriesloom.llm.common import in_fold
from seriesloom.session import store

# Families of identity terms that may stand for one another, in the corpus' languages. The
# first of each family is its neutral member.
FAMILIES = (
    ("people", "women", "men", "girls", "boys"),
    ("person", "woman", "man", "girl", "boy"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("coloured", "black", "white", "asian", "latino", "arab"),
    ("sexual", "gay", "lesbian", "straight", "bisexual", "transgender"),
    ("national", "american", "german", "french", "spanish", "mexican", "chinese", "african"),
    ("residents", "immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("menschen", "frauen", "männer", "juden", "christen", "muslime", "ausländer"),
    ("gens", "femmes", "hommes", "juifs", "chrétiens", "musulmans", "immigrés"),
    ("personas", "mujeres", "hombres", "judíos", "cristianos", "musulmanes", "inmigrantes"),
)

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


PREFIXES = (4, 5, 6, 7)
SHARED = (2, 4)
CACHE = 300_000


def features(found: set[str]) -> set[str]:
    """Presence features of a set of distinct words."""
    got = {"=" + w for w in found}
    shared: dict[str, int] = {}
    for w in found:
        for n in PREFIXES:
            if len(w) >= n:
                shared[w[:n]] = shared.get(w[:n], 0) + 1
    for prefix, count in shared.items():
        got.add("^" + prefix)
        got.update(f"^{prefix}#{n}" for n in SHARED if count >= n)
    return got


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swaps(words: set[str], families=FAMILIES) -> list[tuple[str, str]]:
    """(term, replacement) for every identity term of a sentence; the neutral member stands for none, ""."""
    return [
        (term, "" if k == 0 else other)
        for family in families for term in family[1:] if term in words
        for k, other in enumerate(family) if other != term
    ]


def swap_pairs(text: str, families=FAMILIES) -> list[tuple[str, str]]:
    """Counterfactuals of a text, sentence by sentence."""
    terms = {t for family in families for t in family[1:]}
    lowered = text.lower()
    if not terms & set(WORD.findall(lowered)):
        return []
    return [pair for sentence in SENTENCE.split(lowered) for pair in swaps(set(WORD.findall(sentence)), families)]


class ToxicityModel(NamedTuple):
    """Weights of the selected features."""

    weights: dict[str, float]
    intercept: float

    def scorer(self):
        """Scores texts; the weighted features of a word are kept in a bounded cache."""
        weights, intercept = self.weights, self.intercept
        stems = {f[1:].partition("#")[0] for f in weights if f[0] == "^"}

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= CACHE:
                    self.clear()
                own = [word[:n] for n in PREFIXES if len(word) >= n and word[:n] in stems]
                self[word] = hit = (word, own) if own or "=" + word in weights else None
                return hit

        known = Known()

        def score(text: str | None) -> float:
            total, shared = intercept, {}
            for word, stems_hit in sorted(filter(None, map(known.__getitem__, text_words(text)))):
                total += weights.get("=" + word, 0.0)
                for stem in stems_hit:
                    shared[stem] = shared.get(stem, 0) + 1
            for stem, count in shared.items():
                total += weights.get("^" + stem, 0.0)
                for n in SHARED:
                    if count >= n:
                        total += weights.get(f"^{stem}#{n}", 0.0)
            return float(sigmoid(total))

        return score


def g_squared(ones, zeros, n_one, n_zero):
    """Association of a feature with the class, from its document counts in both classes (numpy or columns)."""
    total, present = n_one + n_zero, ones + zeros
    cells = ((ones, present, n_one), (zeros, present, n_zero),
             (n_one - ones, total - present, n_one), (n_zero - zeros, total - present, n_zero))
    return sum(2 * cell * F.log((cell + 1e-9) * total / (row * column + 1e-9)) for cell, row, column in cells)


def fit(samples: list[tuple[list[str], list[tuple[str, str]], int]], vocabulary: list[str], prior: float,
        penalty: float = 20.0, ridge: float = 1.0, rounds: int = 25, counted: dict[tuple[str, str], int] | None = None) -> ToxicityModel:
    """Newton iterations on (features, swap pairs, label) rows.

    ``counted`` holds swap pairs that are counted already. Each swap pair adds penalty * (score difference)^2 to the loss. ``prior`` is the share of class 1 in all labelled
    rows; the balanced sample is weighted back to it.
    """
    labels = np.array([y for _, _, y in samples], float)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1.0)
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    at = {f: k + 1 for k, f in enumerate(vocabulary)}  # column 0 is the intercept
    x = np.zeros((len(samples), len(at) + 1), np.float32)
    x[:, 0] = 1.0
    pairs = dict(counted or {})
    for k, (own, swapped, _) in enumerate(samples):
        x[k, [at[f] for f in own if f in at]] = 1.0
        for pair in swapped:
            pairs[pair] = pairs.get(pair, 0) + 1
    still = np.zeros((len(at) + 1, len(at) + 1))
    for (term, other), count in pairs.items():
        change = np.zeros(len(at) + 1)
        for word, sign in ((term, 1.0), (other, -1.0)):
            for f in features({word}) if word else ():
                if f in at:
                    change[at[f]] += sign
        hit = np.flatnonzero(change)
        still[np.ix_(hit, hit)] += 2 * penalty * count * np.outer(change[hit], change[hit])
    still[np.arange(1, len(at) + 1), np.arange(1, len(at) + 1)] += ridge
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    w = np.zeros(len(at) + 1)
    w[0] = np.log(prior / (1 - prior))

    def loss(w):
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - labels * z)).sum() + w @ still @ w / 2)

    current = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - labels)) + still @ w
        curve = (x * (weight * p * (1 - p))[:, None].astype(np.float32)).T @ x + still + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        rate = 1.0
        while rate > 1e-4 and (after := loss(w - rate * step)) > current:
            rate /= 2
        if rate <= 1e-4:
            break
        w = w - rate * step
        done, current = current - after < 1e-6 * abs(current), after
        if done:
            break
    return ToxicityModel({f: float(w[k]) for f, k in at.items()}, float(w[0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, kept: int = 1200, min_docs: int = 4,
          penalty: float = 20.0) -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents given (the caller leaves out held-out rows).

    At most ``2 * per_class`` documents are read for it, and at most ``kept`` features of each reach the driver.
    """
    known = clean_labels(labels, "toxic")
    shares = known.agg(F.count("y").alias("n"), F.sum("y").alias("ones")).first()
    if not shares["n"]:
        return ToxicityModel({}, 0.0)
    prior = min(max(shares["ones"] / shares["n"], 1e-4), 1 - 1e-4)
    # Bounded: at most 2 * per_class rows of ids.
    chosen = F.broadcast(bounded_sample(known, per_class))
    texts = store(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, "doc_id")
                  .select("y", "text"), "sample")

    def count(batches):
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
                for f in features(text_words(text.as_py())):
                    sums.setdefault(f, [0, 0])[y] += 1
            names = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([sums[f][y] for f in names], pa.int64()) for y in (0, 1))],
                ["feature", "zeros", "ones"])

    n_one, n_zero = (texts.where(F.col("y") == y).count() for y in (1, 0))
    neutral = sorted(features({family[0] for family in FAMILIES}))
    sums = texts.mapInArrow(count, "feature string, zeros long, ones long").groupBy("feature").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    strongest = sums.where(F.col("zeros") + F.col("ones") >= min_docs).where(~F.col("feature").isin(neutral)).withColumn(
        "g", g_squared(F.col("ones"), F.col("zeros"), F.lit(n_one), F.lit(n_zero))).orderBy(F.desc("g"), "feature").limit(kept)
    terms = {"=" + t for family in FAMILIES for t in family[1:]}
    vocabulary = sorted({r["feature"] for r in strongest.select("feature").collect()} | terms)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def select(batches):
        selected = shared.value
        for batch in batches:
            found = [sorted(features(text_words(t.as_py())) & selected) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.string()))], ["y", "found"])

    rows = texts.mapInArrow(select, "y int, found array<string>").collect()
    samples = sorted((list(r["found"]), [], r["y"]) for r in rows)
    counted = {(r["term"], r["other"]): r["n"] for r in sorted(swap_counts(texts).collect())}
    return fit(samples, vocabulary, prior, penalty, counted=counted)


def swap_counts(texts: DataFrame) -> DataFrame:
    """term, other, n over all texts: at most one row per swap pair of the families, however often it occurs."""

    def count(batches):
        for batch in batches:
            sums = Counter(p for t in batch.column("text") for p in swap_pairs(t.as_py() or ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in sums], pa.string()), pa.array([p[1] for p in sums], pa.string()), pa.array(list(sums.values()), pa.int64())],
                ["term", "other", "n"])

    return texts.mapInArrow(count, "term string, other string, n long").groupBy("term", "other").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for every document. The model is a bounded list of features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        rate = shared.value.scorer()
        for batch in batches:
            values = np.array([rate(text.as_py()) for text in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        apply, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, **fitting) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, score all documents."""
    model = train(docs, labels.where(~in_fold(F.col("doc_id"), parts, held)), **fitting)
    scored = score(docs, model)
    return scored.select("doc_id", in_fold(F.col("doc_id"), parts, held).alias("held_out"), "score", "predicted")
