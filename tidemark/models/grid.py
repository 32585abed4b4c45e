"""Future time grid of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.functions.frequency import shift_periods
from tidemark.operators.keys import key_columns


def future_grid(
    last: DataFrame, last_column: str, horizon: int, frequency: str, keys: Sequence[str] = (), gap: int = 0
) -> DataFrame:
    """``horizon`` rows per row of ``last``: keys, ``step`` from 1 and ``ds`` after the gap."""
    if horizon < 1 or gap < 0:
        raise ValueError("horizon must be at least 1 and gap at least 0")
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    rest = [col(c) for c in last.columns if c not in (*keys, last_column)]
    rows = last.select(*key_columns(keys), col(last_column).alias("__last"), *rest, steps)
    ds = shift_periods(F.col("__last"), F.col("step") + F.lit(gap), frequency)
    return rows.select(*key_columns(keys), "step", ds.alias("ds"), *rest)
