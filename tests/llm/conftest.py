from __future__ import annotations

import pytest

from seriesloom.llm.shipping import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def session(spark):
    return ship(spark)


@pytest.fixture
def docs(session):
    """Builds a table of documents from (doc_id, text[, lang]) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return session.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def clashing():
    """Extra columns named like those the operators make inside."""
    from pyspark.sql import functions as F

    def add(df):
        for name in ("row", "score", "key", "size", "label_", "words", "keys", "predicted", "y", "part", "rank", "n", "component", "_key", "_KEY_", "_dropped_id", "_dropped_key", "doc", "total", "pair"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return add
