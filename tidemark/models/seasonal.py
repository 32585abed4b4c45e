"""Trend with changepoints, Fourier seasons and holidays by ridge regression per series.

After Taylor and Letham, "Forecasting at Scale" (2018). The normal equations of every
series are sums over its rows: slices of bounded size are multiplied with NumPy inside
tasks, added up by an aggregation, and solved once per series. No task sees a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.functions.frequency import parse_frequency
from tidemark.models.grid import future_grid
from tidemark.operators.join import holiday_flag
from tidemark.operators.keys import attach, key_columns
from tidemark.operators.sequence import sequence

ROWS_PER_SLICE = 50_000
NOISE_VARIANCE = 0.01
SECONDS_PER_DAY = 86400.0


@dataclass(frozen=True)
class SeasonalConfig:
    changepoints: int = 8
    changepoint_range: float = 0.8
    weekly_order: int = 3
    yearly_order: int = 5
    daily_order: int = 0
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    with_holidays: bool = False

    @staticmethod
    def for_frequency(frequency: str | None, with_holidays: bool = False) -> SeasonalConfig:
        """Seasons longer than a period: none weekly for weekly data, daily only below a day."""
        freq = parse_frequency(frequency)
        sub_daily = freq.is_fixed and freq.seconds < SECONDS_PER_DAY
        weekly = 3 if freq.is_fixed and freq.seconds <= SECONDS_PER_DAY else 0
        return SeasonalConfig(weekly_order=weekly, daily_order=4 if sub_daily else 0, with_holidays=with_holidays)

    def size(self) -> int:
        return 2 + self.changepoints + 2 * (self.weekly_order + self.yearly_order + self.daily_order) + int(self.with_holidays)

    def penalties(self) -> list[float]:
        bend = NOISE_VARIANCE / self.changepoint_prior_scale**2
        season = NOISE_VARIANCE / self.seasonality_prior_scale**2
        waves = 2 * (self.weekly_order + self.yearly_order + self.daily_order) + int(self.with_holidays)
        return [1e-8, 1e-8] + [bend] * self.changepoints + [season] * waves


def design(ds: Column, start: Column, end: Column, c: SeasonalConfig) -> Column:
    """Regressor array of one row; ``start`` and ``end`` bound the training part of its series.

    A season longer than the training part cannot be told from the trend and is left out.
    """
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = lambda t: F.timestamp_diff("SECOND", zero, t.cast("timestamp_ntz")).cast("double")
    span = seconds(end) - seconds(start)
    t = F.coalesce((seconds(ds) - seconds(start)) / F.nullif(span, F.lit(0.0)), F.lit(0.0))
    terms = [F.lit(1.0), t]
    for j in range(1, c.changepoints + 1):
        terms.append(F.greatest(F.lit(0.0), t - c.changepoint_range * j / (c.changepoints + 1)))
    for days, order in ((1.0, c.daily_order), (7.0, c.weekly_order), (365.25, c.yearly_order)):
        seen = (span >= days * SECONDS_PER_DAY).cast("double")
        for k in range(1, order + 1):
            angle = seconds(ds) / SECONDS_PER_DAY * (2 * math.pi * k / days)
            terms += [F.sin(angle) * seen, F.cos(angle) * seen]
    if c.with_holidays:
        terms.append(F.coalesce(F.col("is_holiday"), F.lit(0)).cast("double"))
    return F.array(*terms)


def _partial_sums(size: int, keys: Sequence[str]):
    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf["__x"].to_numpy())
        y = pdf["__y"].to_numpy(dtype=float)
        out = {k: [pdf[k].iloc[0]] for k in keys}
        out["__sums"] = [np.concatenate([(x.T @ x).ravel(), x.T @ y])]
        return pd.DataFrame(out)

    return sums


def fit_seasonal(
    df: DataFrame, datetime_column: str, target: str, keys: Sequence[str] = (),
    config: SeasonalConfig | None = None, holidays: DataFrame | None = None,
    strategy: str = "banded", bands: int | None = None,
) -> DataFrame:
    """One row per series: its span, scale, row count and coefficient array."""
    c = config or SeasonalConfig()
    by = key_columns(keys)
    rows = df.where(col(target).isNotNull() & col(datetime_column).isNotNull())
    spans = rows.groupBy(*by).agg(
        F.min(col(datetime_column)).alias("start"), F.max(col(datetime_column)).alias("end"),
        F.coalesce(F.nullif(F.max(F.abs(col(target).cast("double"))), F.lit(0.0)), F.lit(1.0)).alias("scale"),
        F.count(F.lit(1)).alias("n_train"),
    )
    indexed = sequence(rows, datetime_column, keys, strategy, bands).with_index("__idx")
    if c.with_holidays:
        indexed = holiday_flag(indexed, datetime_column, holidays)
    placed = attach(indexed, spans, keys, ["start", "end", "scale"])
    slices = placed.select(
        *by,
        F.floor(F.col("__idx") / ROWS_PER_SLICE).alias("__slice"),
        design(col(datetime_column), F.col("start"), F.col("end"), c).alias("__x"),
        (col(target).cast("double") / F.col("scale")).alias("__y"),
    )
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("__sums", T.ArrayType(T.DoubleType()))])
    partial = slices.groupBy(*by, "__slice").applyInPandas(_partial_sums(c.size(), keys), schema)
    added = (
        partial.select(*by, F.posexplode("__sums").alias("__at", "__v"))
        .groupBy(*by, "__at").agg(F.sum("__v").alias("__v"))
        .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("__e"))
        .select(*by, F.transform("__e", lambda e: e["__v"]).alias("__e"))
    )
    size, penalties = c.size(), np.array(c.penalties())

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(sums: pd.Series) -> pd.Series:
        def one(values):
            v = np.asarray(values, dtype=float)
            gram = v[: size * size].reshape(size, size) + np.diag(penalties)
            return np.linalg.solve(gram, v[size * size :])

        return sums.map(one)

    return attach(spans, added.select(*by, solve("__e").alias("beta")), keys, ["beta"])


def predict_rows(rows: DataFrame, ds: str, fitted: DataFrame, keys: Sequence[str], c: SeasonalConfig) -> DataFrame:
    """Add ``prediction`` to rows with keys and a time."""
    names = ["start", "end", "scale", "beta"]
    placed = attach(rows, fitted, keys, names)
    x = design(col(ds), F.col("start"), F.col("end"), c)
    dot = F.aggregate(F.zip_with(x, F.col("beta"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return placed.withColumn("prediction", dot * F.col("scale")).drop(*names)


def forecast_seasonal(
    df: DataFrame, datetime_column: str, target: str, horizon: int, frequency: str = "D",
    keys: Sequence[str] = (), gap: int = 0, config: SeasonalConfig | None = None,
    holidays: DataFrame | None = None, strategy: str = "banded", bands: int | None = None,
) -> DataFrame:
    c = config or SeasonalConfig.for_frequency(frequency, holidays is not None)
    fitted = fit_seasonal(df, datetime_column, target, keys, c, holidays, strategy, bands)
    return predict_seasonal(fitted, c, horizon, frequency, keys, gap, holidays)


def predict_seasonal(
    fitted: DataFrame, c: SeasonalConfig, horizon: int, frequency: str = "D", keys: Sequence[str] = (), gap: int = 0,
    holidays: DataFrame | None = None, last: DataFrame | None = None,
) -> DataFrame:
    """The horizon after the training part of every series, or after the times ``end`` of ``last``.

    A series of ``last`` that was not fitted has null predictions.
    """
    ends = fitted if last is None else last
    grid = future_grid(ends.select(*key_columns(keys), "end"), "end", horizon, frequency, keys, gap)
    if c.with_holidays:
        grid = holiday_flag(grid, "ds", holidays)
    out = predict_rows(grid, "ds", fitted, keys, c)
    return out.select(*key_columns(keys), "step", "ds", "prediction", F.lit("seasonal").alias("model_name"))


def holdout_seasonal(
    df: DataFrame, datetime_column: str, target: str, frequency: str = "D", keys: Sequence[str] = (),
    config: SeasonalConfig | None = None, holidays: DataFrame | None = None,
    train_fraction: float = 0.8, min_rows: int = 20, strategy: str = "banded", bands: int | None = None, gap: int = 0,
) -> DataFrame:
    """Test rows of each series, from ``gap`` after its training part, with the prediction from that part."""
    c = config or SeasonalConfig.for_frequency(frequency, holidays is not None)
    rows = df.where(col(target).isNotNull() & col(datetime_column).isNotNull())
    indexed = sequence(rows, datetime_column, keys, strategy, bands).with_index("__idx", "__total").where(
        F.col("__total") >= min_rows
    )
    n_train = F.floor(F.col("__total") * F.lit(float(train_fraction)))
    is_train = F.col("__idx") < n_train
    plain = [*key_columns(keys), col(datetime_column), col(target)]
    fitted = fit_seasonal(indexed.where(is_train).select(*plain), datetime_column, target, keys, c, holidays, strategy, bands)
    test = indexed.where(F.col("__idx") >= n_train + gap).select(*plain)
    if c.with_holidays:
        test = holiday_flag(test, datetime_column, holidays)
    scored = predict_rows(test, datetime_column, fitted, keys, c)
    return scored.select(
        *key_columns(keys), col(datetime_column), col(target).cast("double").alias("actual"),
        F.lit("seasonal").alias("model"), F.col("prediction").alias("predicted"),
    )
