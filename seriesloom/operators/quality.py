"""Row expectations and table tests."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class QualityError(RuntimeError):
    """At least one table test failed."""


def _holds(predicate: str) -> Column:
    """A predicate that is NULL counts as violated."""
    return F.coalesce(F.expr(predicate), F.lit(False))


def drop_violations(df: DataFrame, expectations: Mapping[str, str]) -> DataFrame:
    """Keep the rows that meet every expectation."""
    return reduce(lambda rows, p: rows.where(_holds(p)), expectations.values(), df)


def violation_counts(expectations: Mapping[str, str]) -> list[Column]:
    """One count per expectation, for use in an aggregate or an observation."""
    return [F.count_if(~_holds(p)).alias(name) for name, p in expectations.items()]


def count_violations(df: DataFrame, expectations: Mapping[str, str]) -> DataFrame:
    """One row: all rows, and the violations of each expectation."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), *violation_counts(expectations))


def observe_violations(df: DataFrame, name: str, expectations: Mapping[str, str]) -> tuple[DataFrame, Observation]:
    """Count violations while the rows pass by, without a second pass over them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("row_count"), *violation_counts(expectations)), seen


# -- table tests: each gives rows (table_name, check_name, columns, violations)


def _report(table: str, check: str, columns: str, violations: DataFrame) -> DataFrame:
    return violations.select(
        F.lit(table).alias("table_name"),
        F.lit(check).alias("check_name"),
        F.lit(columns).alias("column_names"),
        F.coalesce(F.col("violations"), F.lit(0)).cast("bigint").alias("violations"),
    )


def not_null(table: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs in each of several columns, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot([], list(columns), "column_names", "violations")
    return long.select(
        F.lit(table).alias("table_name"),
        F.lit("not_null").alias("check_name"),
        "column_names",
        F.col("violations").cast("bigint").alias("violations"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of copies."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def unique(table: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys held by more than one row; NULL keys are left to the not-null test."""
    present = df.na.drop(subset=list(keys))
    counted = duplicate_keys(present, keys).agg(F.count(F.lit(1)).alias("violations"))
    return _report(table, "unique", ",".join(keys), counted)


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Key values without a parent row, and how many rows carry them.

    Rows are counted per key first, so that neither a frequent key nor the row count of the child
    table decides the size of the join.
    """
    parent_key = parent_key or key
    children = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("orphan_rows"))
    parents = parent.select(F.col(parent_key).alias(key)).distinct()
    return children.join(parents, key, "left_anti")


def relationship(table: str, df: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    lost = orphans(df, key, parent, parent_key).agg(F.sum("orphan_rows").alias("violations"))
    return _report(table, "relationship", key, lost)


def report(checks: Iterable[DataFrame]) -> DataFrame:
    """All checks as one table."""
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """Raise if any check found a violation; there is one row per check."""
    failed = checks.where(F.col("violations") > 0).collect()
    if failed:
        lines = [f"{r.table_name}.{r.column_names} {r.check_name}: {r.violations}" for r in failed]
        raise QualityError("; ".join(sorted(lines)))


def stale(newest: Column, now: Column, limit_hours: int = 30) -> Column:
    """Whether the newest export is too old; no export at all counts as stale."""
    age = F.unix_seconds(now) - F.unix_seconds(newest)
    return F.coalesce(age > limit_hours * 3600, F.lit(True))


def require_fresh(exports: DataFrame, column: str, now: datetime.datetime, limit_hours: int = 30) -> None:
    """Raise unless some export is recent enough."""
    verdict = exports.agg(F.max(column).alias("newest")).select(
        stale(F.col("newest"), F.lit(now), limit_hours).alias("stale")
    )
    if verdict.first()["stale"]:
        raise QualityError(f"the newest export is more than {limit_hours} hours old")
