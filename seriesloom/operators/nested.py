"""VARIANT and array columns to typed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_fields(
    paths: Mapping[str, tuple[str, str]], raw: str = "raw", tolerant: bool = False
) -> list[Column]:
    """Typed columns ``name -> (path, type)`` out of a VARIANT column.

    Strict by default: a value of the wrong type raises. With ``tolerant`` it becomes NULL.
    """
    get = F.try_variant_get if tolerant else F.variant_get
    return [get(F.col(raw), path, kind).alias(name) for name, (path, kind) in paths.items()]


def explode_parallel(df: DataFrame, arrays: Sequence[str], keep: Sequence[str], fill_missing: bool = False) -> DataFrame:
    """One row per position of parallel arrays.

    A shorter array is padded with NULL. A row in which any array is missing gives no rows at all,
    unless ``fill_missing`` treats the missing array as empty.
    """
    if fill_missing:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        parts = [F.coalesce(F.col(a), F.array().cast(kinds[a])).alias(a) for a in arrays]
        df = df.select(*keep, *parts)
    rows = df.select(*keep, F.explode(F.arrays_zip(*arrays)).alias("_item"))
    return rows.select(*keep, *[F.col(f"_item.{a}").alias(a) for a in arrays])
