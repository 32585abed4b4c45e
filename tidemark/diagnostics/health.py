"""Residual, baseline, sanity and health diagnostics, one row per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col, is_non_negative_name
from tidemark.models.evaluate import improvement_pct, mae, mape, rmse
from tidemark.operators.keys import attach, key_columns
from tidemark.operators.sequence import sequence
from tidemark.operators.stats import correlation

# Name fragments for which a negative forecast is suspicious.
SANITY_NAMES = ("count", "quantity", "volume", "sales", "revenue", "price")

# Lower bounds of the health bands.
HEALTH_BANDS = ((85, "EXCELLENT"), (70, "GOOD"), (50, "FAIR"))


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.withColumn("residual", col(actual) - col(predicted))


def residual_analysis(
    df: DataFrame,
    order_by: str | Sequence[str],
    keys: Sequence[str] = (),
    actual: str = "actual",
    predicted: str = "predicted",
    strategy: str = "banded",
    bands: int | None = None,
) -> DataFrame:
    """Mean, population deviation, lag-1 correlation, trend and randomness of the residuals."""
    by = key_columns(keys)
    r = F.col("residual")
    ordered = sequence(residuals(df, actual, predicted), order_by, keys, strategy, bands)
    indexed = ordered.with_index("__idx")
    n = F.count(F.lit(1))
    slope = F.regr_slope(r, F.col("__idx").cast("double"))
    trending = F.coalesce((n >= 10) & (F.abs(slope) > 0.1 * F.stddev_pop(r)), F.lit(False))
    stats = indexed.groupBy(*by).agg(
        n.alias("n"), F.avg(r).alias("mean_residual"), F.stddev_pop(r).alias("std_residual"), trending.alias("has_trend")
    )
    pairs = ordered.over({"__before": lambda w: F.lag("residual").over(w)}, lookback=1)
    autocorrelation = F.when(n > 1, correlation(r, F.col("__before"))).otherwise(F.lit(0.0))
    lagged = pairs.groupBy(*by).agg(autocorrelation.alias("autocorr_lag1"))
    out = attach(stats, lagged, keys, ["autocorr_lag1"])
    random = F.coalesce(F.abs("autocorr_lag1") < 0.2, F.lit(False)) & ~F.col("has_trend")
    return out.withColumn("is_random", random)


def baseline_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    actual: str = "actual",
    predicted: str = "predicted",
    naive: str = "naive",
) -> DataFrame:
    """Errors of the model and of the naive forecast side by side, from one aggregation."""
    a, p, b = col(actual), col(predicted), col(naive)
    made = df.groupBy(*key_columns(keys)).agg(
        mae(a, p).alias("mae_model"), rmse(a, p).alias("rmse_model"), mape(a, p).alias("mape_model"),
        mae(a, b).alias("mae_naive"), rmse(a, b).alias("rmse_naive"), mape(a, b).alias("mape_naive"),
    )
    return made.withColumns(
        {
            "rmse_improvement_pct": improvement_pct(F.col("rmse_model"), F.col("rmse_naive")),
            "mape_improvement_pct": improvement_pct(F.col("mape_model"), F.col("mape_naive")),
            "beats_baseline": improvement_pct(F.col("rmse_model"), F.col("rmse_naive")) > 0,
        }
    )


def _note(code: str, *message: Column | str) -> Column:
    parts = [F.lit(m) if isinstance(m, str) else F.format_string("%.1f", m.cast("double")) for m in message]
    return F.struct(F.lit(code).alias("code"), F.concat(*parts).alias("message"))


def _notes(*rules: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, note) for condition, note in rules]))


def forecast_sanity(
    forecast: DataFrame,
    history: DataFrame,
    datetime_column: str,
    target: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    metric_name: str | None = None,
) -> DataFrame:
    """Per series the figures behind, and the list of, ``sanity_warnings``.

    ``forecast`` has ``step`` and ``prediction``. A constant history has no range, so
    only the share of the excess is left out of its messages.
    """
    by = key_columns(keys)
    order = F.struct(col(datetime_column), *[col(t) for t in tiebreak])
    past = history.where(col(target).isNotNull()).groupBy(*by).agg(
        F.min(col(target)).cast("double").alias("hist_min"),
        F.max(col(target)).cast("double").alias("hist_max"),
        F.max_by(col(target), order).cast("double").alias("last_actual"),
    )
    ahead = forecast.groupBy(*by).agg(
        F.min("prediction").alias("pred_min"),
        F.max("prediction").alias("pred_max"),
        F.min_by("prediction", "step").alias("first_prediction"),
        F.count_if(F.col("prediction") < 0).alias("n_negative"),
    )
    out = attach(ahead, past, keys, ["hist_min", "hist_max", "last_actual"])
    span = F.col("hist_max") - F.col("hist_min")
    above, below = F.col("pred_max") - F.col("hist_max"), F.col("hist_min") - F.col("pred_min")
    share = lambda excess: F.coalesce(excess / F.nullif(span, F.lit(0.0)) * 100, F.lit(0.0))
    change = (F.col("first_prediction") - F.col("last_actual")) / F.nullif(F.abs("last_actual"), F.lit(0.0)) * 100
    guarded = F.lit(is_non_negative_name(metric_name or target, SANITY_NAMES))
    return out.withColumn("first_change_pct", change).withColumn(
        "sanity_warnings",
        _notes(
            (guarded & (F.col("n_negative") > 0), _note("negative_forecast", F.col("n_negative"), " negative predictions")),
            (above > 0.5 * span, _note("above_history", "maximum exceeds the historical range by ", share(above), "%")),
            (below > 0.5 * span, _note("below_history", "minimum is below the historical range by ", share(below), "%")),
            (F.abs(change) > 50, _note("jump", "first step changes by ", change, "%")),
        ),
    )


def trust_indicators() -> Column:
    """Positive signals on a row of residual, baseline, quality and sanity columns."""
    age, missing = F.col("data_age_days"), F.col("missing_pct")
    return _notes(
        (F.col("beats_baseline"), _note("beats_naive", "beats naive by ", F.col("rmse_improvement_pct"), "%")),
        (F.col("is_random"), _note("random_residuals", "residuals look random")),
        (missing < 5, _note("complete_data", 100 - missing, "% complete")),
        (age < 7, _note("fresh_data", age, " days old")),
        (F.size("sanity_warnings") == 0, _note("sane_forecast", "passes all sanity checks")),
    )


def warnings() -> Column:
    """All warnings on the same row, the sanity warnings last."""
    age, missing, outliers = F.col("data_age_days"), F.col("missing_pct"), F.col("outliers_pct")
    own = _notes(
        (~F.col("beats_baseline"), _note("not_beating_naive", "does not beat the naive baseline")),
        (
            ~F.col("is_random") & (F.abs("autocorr_lag1") > 0.4),
            _note("autocorrelated", "residuals are autocorrelated"),
        ),
        (~F.col("is_random") & F.col("has_trend"), _note("trending_residuals", "residuals show a trend")),
        (missing > 10, _note("missing_data", missing, "% of the data was missing")),
        (outliers > 5, _note("outliers", outliers, "% of the data are outliers")),
        (age > 30, _note("stale_data", age, " days old")),
        ((age > 7) & (age <= 30), _note("aging_data", age, " days old")),
        (F.col("total_rows") < 50, _note("few_rows", "too few rows for a reliable forecast")),
    )
    return F.concat(own, F.col("sanity_warnings"))


def health_components() -> dict[str, Column]:
    """Four parts of 25 points each; an unknown age scores nothing."""
    strength = F.coalesce(F.abs("autocorr_lag1"), F.lit(1.0))
    missing, outliers, age = F.col("missing_pct"), F.col("outliers_pct"), F.col("data_age_days")
    quality = (
        F.when(missing < 5, 10.0).when(missing < 15, 5.0).otherwise(0.0)
        + F.when(outliers < 5, 5.0).when(outliers < 10, 2.0).otherwise(0.0)
        + F.when(age < 7, 10.0).when(age < 30, 5.0).otherwise(0.0)
    )
    return {
        "residual_points": F.when(F.col("is_random"), 25.0).when(strength < 0.4, 15.0).otherwise(5.0),
        "baseline_points": F.when(
            F.col("beats_baseline"), F.least(F.lit(25.0), 10.0 + F.col("rmse_improvement_pct") / 2)
        ).otherwise(0.0),
        "quality_points": quality,
        "warning_points": F.greatest(F.lit(0.0), 25.0 - 5.0 * F.size("warnings")),
    }


def health_score(diagnosed: DataFrame) -> DataFrame:
    """Add ``trust``, ``warnings``, the four parts, ``health_score`` and ``health_band``.

    Expects the columns of the residual, baseline, quality and sanity results.
    """
    out = diagnosed.withColumn("trust", trust_indicators()).withColumn("warnings", warnings())
    parts = health_components()
    out = out.withColumns(parts)
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    return out.withColumn("health_score", total).withColumn("health_band", health_band(F.col("health_score")))


def health_band(score: Column) -> Column:
    band = None
    for bound, name in HEALTH_BANDS:
        band = F.when(score >= bound, name) if band is None else band.when(score >= bound, name)
    return band.otherwise("POOR")


def diagnose(
    test: DataFrame,
    quality: DataFrame,
    sanity: DataFrame | None,
    order_by: str | Sequence[str],
    keys: Sequence[str] = (),
    strategy: str = "banded",
    bands: int | None = None,
) -> DataFrame:
    """Per-series diagnosis from test rows (``actual, predicted, naive``), all series at once."""
    base = baseline_metrics(test, keys)
    analysed = residual_analysis(test, order_by, keys, strategy=strategy, bands=bands)
    out = attach(analysed, base, keys, base.columns[len(keys):])
    out = attach(out, quality, keys, ["total_rows", "missing_pct", "outliers_pct", "data_age_days"])
    empty = F.array().cast("array<struct<code:string,message:string>>")
    if sanity is None:
        out = out.withColumn("sanity_warnings", empty)
    else:
        out = attach(out, sanity, keys, ["sanity_warnings"]).withColumn(
            "sanity_warnings", F.coalesce("sanity_warnings", empty)
        )
    return health_score(out)
