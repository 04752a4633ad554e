"""Small helpers of the learned document classifiers: bounded samples, logistic link, clean labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, y) per labelled id. Unlabelled rows go; where repeated rows disagree, 1 wins."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("y"))
    return known.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def bounded_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """Up to ``per_class`` ids of each class, those with the smallest hashes, so any run draws the same.

    The two top-k steps keep at most that many rows per task; the result holds at most twice as many.
    """
    spread = labels.withColumn("spread", F.xxhash64("doc_id"))
    parts = [spread.where(F.col("y") == y).orderBy("spread", "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1]).drop("spread")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))
