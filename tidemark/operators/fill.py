"""Missing-value filling along a series, by statistics, by constants, or on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col, is_numeric, require
from tidemark.functions.frequency import bucket_start, parse_frequency, shift_periods
from tidemark.operators.keys import attach
from tidemark.operators.sequence import sequence
from tidemark.operators.stats import quantiles

DIRECTIONAL = ("ffill", "bfill", "interpolate")


def fill_missing(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    method: str | float | int = "ffill",
    order_by: str | Sequence[str] | None = None,
    keys: Sequence[str] = (),
    value: object = None,
    strategy: str = "banded",
    bands: int | None = None,
) -> DataFrame:
    """Fill nulls in one, some or (``None`` / ``__all__``) all columns.

    ``ffill``, ``bfill`` and ``interpolate`` follow ``order_by`` within ``keys``;
    ``interpolate`` is linear in the row position and leaves the ends null. ``mean``,
    ``median`` and ``interpolate`` skip columns that are not numeric. A number in place
    of the method fills with that number.
    """
    if columns in (None, "__all__"):
        used = set(keys) | set([order_by] if isinstance(order_by, str) else order_by or [])
        names = [c for c in df.columns if c not in used]
    else:
        names = [columns] if isinstance(columns, str) else list(columns)
    require(df, *names)
    if not isinstance(method, str):
        method, value = "value", method
    elif method not in (*DIRECTIONAL, "mean", "median", "zero", "value", "drop"):
        try:
            method, value = "value", float(method)
        except ValueError:
            raise ValueError(f"unknown fill method {method!r}") from None

    if method in ("mean", "median", "interpolate", "zero"):
        names = [c for c in names if is_numeric(df.schema[c].dataType)]
    if not names:
        return df
    if method == "drop":
        return df.dropna(subset=names)
    if method == "zero":
        return df.fillna(0, subset=names)
    if method == "value":
        if value is None:
            raise ValueError("method='value' needs a value")
        return df.fillna(value, subset=names)
    if method in ("mean", "median"):
        return _fill_statistic(df, names, method, keys, strategy)
    if order_by is None:
        raise ValueError(f"method={method!r} needs order_by")

    rows = sequence(df, order_by, keys, strategy, bands).neighbours(names)
    filled = {}
    for i, name in enumerate(names):
        before, after = F.col(f"__prev_{i}"), F.col(f"__next_{i}")
        if method == "ffill":
            filled[name] = before["v"]
        elif method == "bfill":
            filled[name] = after["v"]
        else:
            share = (F.col("__pos") - before["g"]) / F.nullif(
                (after["g"] - before["g"]).cast("double"), F.lit(0.0)
            )
            line = before["v"] + (after["v"] - before["v"]) * share
            filled[name] = F.coalesce(col(name).cast("double"), line)
    return rows.withColumns(filled).select(*[col(c) for c in df.columns])


def _fill_statistic(
    df: DataFrame, names: Sequence[str], method: str, keys: Sequence[str], strategy: str
) -> DataFrame:
    stat_names = [f"__stat_{i}" for i in range(len(names))]
    if method == "mean":
        stats = df.groupBy(*[col(k) for k in keys]).agg(
            *[F.avg(col(c)).alias(s) for c, s in zip(names, stat_names)]
        )
        out = attach(df, stats, keys, stat_names)
    else:
        out = df
        for c, s in zip(names, stat_names):
            out = attach(out, quantiles(df, c, {s: 0.5}, keys, strategy=strategy), keys, [s])
    filled = {c: F.coalesce(col(c).cast("double"), F.col(s)) for c, s in zip(names, stat_names)}
    return out.withColumns(filled).drop(*stat_names)


# Periods that one array holds while a grid is made.
GRID_BLOCK = 10_000


def fix_frequency(
    df: DataFrame,
    datetime_column: str,
    frequency: str,
    keys: Sequence[str] = (),
    method: str = "resample_ffill",
    strategy: str = "banded",
) -> DataFrame:
    """Put each series on its full time grid and fill the new rows.

    The input holds one row per key and period. The grid of one series has as many
    rows as the calendar has periods between its ends, whatever the row count.
    """
    fill = {"resample_ffill": "ffill", "resample_interpolate": "interpolate"}[method]
    freq = parse_frequency(frequency)
    ts = bucket_start(col(datetime_column), freq)
    spans = df.groupBy(*[col(k) for k in keys]).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    if freq.is_fixed:
        periods = F.floor(F.timestamp_diff("SECOND", F.col("__lo"), F.col("__hi")) / freq.seconds)
    else:
        periods = F.floor(F.timestamp_diff("MONTH", F.col("__lo"), F.col("__hi")) / freq.months)
    # Two stages keep every array short: a series of many periods becomes blocks, spread
    # over the cluster, and each block its periods.
    last = periods.cast("long")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__last") / GRID_BLOCK)))
    inside = F.explode(F.sequence(F.col("__block") * GRID_BLOCK, F.least(F.col("__last"), (F.col("__block") + 1) * GRID_BLOCK - 1)))
    grid = (
        spans.where(F.col("__lo").isNotNull())
        .select(*[col(k) for k in keys], "__lo", last.alias("__last"))
        .select(*[col(k) for k in keys], "__lo", "__last", blocks.alias("__block"))
        .repartition(*[col(k) for k in keys], F.col("__block"))
        .select(*[col(k) for k in keys], "__lo", inside.alias("__step"))
        .select(*[col(k) for k in keys], shift_periods(F.col("__lo"), F.col("__step"), freq).alias("__ts"))
    )
    values = [c for c in df.columns if c not in (datetime_column, *keys)]
    observed = df.select(
        *[col(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        ts.alias("__bucket"),
        *[col(v) for v in values],
    )
    on = F.col("__ts") == F.col("__bucket")
    for i, k in enumerate(keys):
        on = on & col(k).eqNullSafe(F.col(f"__key_{i}"))
    gridded = grid.join(observed, on, "left").select(
        *[col(k) for k in keys], F.col("__ts").alias(datetime_column), *[col(v) for v in values]
    )
    return fill_missing(gridded, values, fill, datetime_column, keys, strategy=strategy).select(
        *[col(c) for c in df.columns]
    )
