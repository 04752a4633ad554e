"""Latest row per key, and keyed replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """For each key, the row with the highest sequence (compared column by column).

    An aggregate rather than a ranking: every task first reduces its own rows to one per key, so a
    key with very many versions is never gathered in one task. Rows without a full key are kept out
    by the caller.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    newest = F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_row")
    columns = [F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    return df.groupBy(*keys).agg(newest).select(*columns)


def replace_matching(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in ``new``, followed by all new rows.

    Only the keys of ``new`` take part in the join, so adaptive execution can broadcast them when
    they turn out small and leave the old rows where they are.
    """
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new)
