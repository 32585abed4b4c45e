"""Models with closed forms: naive, linear trend and exponentially weighted level.

A fit is one aggregation per series, whatever its length; all three come out of the
same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.models.grid import future_grid
from tidemark.operators.keys import key_columns
from tidemark.operators.sequence import sequence
from tidemark.operators.series import ewm_alpha

BASELINES = ("naive", "linear", "simple_ewm")
DEFAULT_SPAN = 20


def default_span(n_rows: int) -> int:
    """Span of the short-series model: half the rows, at most 20."""
    return max(1, min(n_rows // 2, DEFAULT_SPAN))


def fit_baselines(
    indexed: DataFrame,
    target: str,
    keys: Sequence[str],
    index: str,
    n: Column,
    span: float = DEFAULT_SPAN,
    datetime_column: str | None = None,
) -> DataFrame:
    """One row of coefficients per series from rows with their 0-based position.

    ``n`` is the number of training rows of the row's series.
    """
    y, i = col(target).cast("double"), col(index)
    a = ewm_alpha(span=span)
    weight = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(a)) * F.pow(F.lit(1 - a), n - 1 - i)
    return indexed.groupBy(*key_columns(keys)).agg(
        F.count(F.lit(1)).alias("n_train"),
        F.max_by(y, i).alias("last_value"),
        F.regr_slope(y, i.cast("double")).alias("slope"),
        F.regr_intercept(y, i.cast("double")).alias("intercept"),
        F.sum(weight * y).alias("level"),
        *([F.max(col(datetime_column)).alias("last_time")] if datetime_column else []),
    )


def baseline_prediction(model: str, position: Column) -> Column:
    """Prediction at a 0-based position of the series from the columns of ``fit_baselines``.

    A single point has no slope; its line is flat.
    """
    if model == "naive":
        return F.col("last_value")
    if model == "linear":
        return F.coalesce(F.col("intercept") + F.col("slope") * position, F.col("last_value"))
    if model == "simple_ewm":
        return F.col("level")
    raise ValueError(f"unknown baseline {model!r}; use one of {BASELINES}")


def forecast_baseline(
    df: DataFrame,
    datetime_column: str,
    target: str,
    horizon: int,
    model: str = "naive",
    frequency: str = "D",
    keys: Sequence[str] = (),
    gap: int = 0,
    tiebreak: Sequence[str] = (),
    span: float = DEFAULT_SPAN,
    strategy: str = "banded",
    bands: int | None = None,
) -> DataFrame:
    """Keys, ``step``, ``ds`` and ``prediction`` for every series."""
    fitted = fit_all_rows(df, datetime_column, target, keys, tiebreak, span, strategy, bands)
    return predict_baseline(fitted, horizon, model, frequency, keys, gap)


def fit_all_rows(
    df: DataFrame, datetime_column: str, target: str, keys: Sequence[str] = (), tiebreak: Sequence[str] = (),
    span: float = DEFAULT_SPAN, strategy: str = "banded", bands: int | None = None,
) -> DataFrame:
    """Coefficients and last time of every series from all its rows with a value."""
    values = df.where(col(target).isNotNull() & col(datetime_column).isNotNull())
    indexed = sequence(values, [datetime_column, *tiebreak], keys, strategy, bands).with_index("__idx", "__total")
    return fit_baselines(indexed, target, keys, "__idx", F.col("__total"), span, datetime_column)


def predict_baseline(
    fitted: DataFrame, horizon: int, model: str, frequency: str = "D", keys: Sequence[str] = (), gap: int = 0
) -> DataFrame:
    """The horizon after the last row of every series, from its row of coefficients."""
    grid = future_grid(fitted.where(F.col("n_train") > 0), "last_time", horizon, frequency, keys, gap)
    position = F.col("n_train") + F.lit(gap) + F.col("step") - 1
    return grid.select(
        *key_columns(keys), "step", "ds", baseline_prediction(model, position).alias("prediction"),
        F.lit(model).alias("model_name"),
    )
