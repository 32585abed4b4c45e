"""Quantiles and fences that stay exact without one task holding a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.operators.sequence import row_at


def _floor_position(q: float, n: Column) -> Column:
    return F.floor(F.lit(q) * (n - 1)).cast("long")


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    keys: Sequence[str] = (),
    method: str = "linear",
    strategy: str = "banded",
    weight: str | None = None,
) -> DataFrame:
    """One row per key with the named quantiles of the non-null values.

    ``linear`` interpolates between ranks, ``nearest`` takes the value at rank
    ``round(q * (n - 1))``, ``approx`` uses ``percentile_approx``. An exact percentile
    holds its whole group in one task, so the distinct values are counted, sorted across
    the cluster and read at the wanted ranks; ``strategy="keyed"`` is for groups that are
    known to be small. ``weight`` names a column of whole counts, how often a row's
    value occurs.
    """
    occurs = col(weight).cast("long") if weight else F.lit(1).cast("long")
    present = df.select(
        *[col(k) for k in keys], col(value).cast("double").alias("__v"), occurs.alias("__w")
    ).where(F.col("__v").isNotNull())
    by = [col(k) for k in keys]
    if method == "approx" and weight is None:
        found = present.groupBy(*by).agg(
            F.percentile_approx("__v", list(probabilities.values()), 10_000).alias("__q")
        )
        return found.select(*by, *[F.get("__q", F.lit(i)).alias(name) for i, name in enumerate(probabilities)])
    if method == "linear" and strategy == "keyed":
        # One call for all probabilities keeps one table of values per group, not several.
        found = present.groupBy(*by).agg(F.percentile("__v", list(probabilities.values()), F.col("__w") if weight else 1).alias("__q"))
        return found.select(*by, *[F.get("__q", F.lit(i)).alias(name) for i, name in enumerate(probabilities)])
    weighted = present.groupBy(*by, "__v").agg(F.sum("__w").alias("__w"))
    if method == "nearest":
        wanted = {
            name: (lambda n, q=q: F.round(F.lit(q) * (n - 1)).cast("long"))
            for name, q in probabilities.items()
        }
        return row_at(weighted, "__v", "__w", wanted, keys, strategy).select(*by, *probabilities)
    if method != "linear":
        raise ValueError(f"unknown quantile method {method!r}")
    wanted = {}
    for name, q in probabilities.items():
        wanted[f"__lo_{name}"] = lambda n, q=q: _floor_position(q, n)
        wanted[f"__hi_{name}"] = lambda n, q=q: F.least(_floor_position(q, n) + 1, n - 1)
    ranked = row_at(weighted, "__v", "__w", wanted, keys, strategy)
    out = []
    for name, q in probabilities.items():
        exact = F.lit(q) * (F.col("n") - 1)
        weight = exact - F.floor(exact)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((low * (1 - weight) + high * weight).alias(name))
    return ranked.select(*by, *out)


def iqr_bounds(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    method: str = "linear",
    strategy: str = "banded",
) -> DataFrame:
    """Per key ``q1, q3, lower, upper``: fences at 1.5 interquartile ranges."""
    quartile = quantiles(df, value, {"q1": 0.25, "q3": 0.75}, keys, method, strategy)
    iqr = F.col("q3") - F.col("q1")
    return quartile.select(
        *[col(k) for k in keys],
        "q1",
        "q3",
        (F.col("q1") - 1.5 * iqr).alias("lower"),
        (F.col("q3") + 1.5 * iqr).alias("upper"),
    )


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0.0 for an empty whole."""
    return F.coalesce(F.try_divide(part * 100.0, whole.cast("double")), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson over the pairs without a null; null when either side is constant.

    ``corr`` itself raises on a constant side when ANSI mode is on.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
