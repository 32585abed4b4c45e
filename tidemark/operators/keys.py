"""Joins of small per-key results back to the rows, null-safe and skew-safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import all_of, col

def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add the columns ``values`` of a one-row-per-key table to every row.

    Without keys the table has one row and becomes scalar subqueries. With keys it
    is a left join, null-safe so that a null key finds its own group; Spark picks
    broadcast from the real size and splits a skewed key at run time.
    """
    if not keys:
        row = per_key.select(F.struct(*[col(v) for v in values]).alias("__row")).scalar()
        return df.withColumns({v: row.getField(v) for v in values})
    renamed = per_key.select(
        *[col(k).alias(f"__key_{i}") for i, k in enumerate(keys)], *[col(v) for v in values]
    )
    on = all_of(col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys))
    return df.join(renamed, on, "left").drop(*[f"__key_{i}" for i in range(len(keys))])


def key_columns(keys: Sequence[str]) -> list[Column]:
    return [col(k) for k in keys]
