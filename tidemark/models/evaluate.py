"""Holdout evaluation, metrics, leaderboards and model choice rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.models.baseline import BASELINES, DEFAULT_SPAN, baseline_prediction, fit_baselines
from tidemark.operators.aggregate import panel_total
from tidemark.operators.keys import attach, key_columns
from tidemark.operators.sequence import sequence

EPSILON = 1e-10
MIN_EVALUATION_ROWS = 20


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, F.lit(2.0))))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def mape(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted) / (F.abs(actual) + F.lit(EPSILON))) * 100


def improvement_pct(value: Column, baseline: Column) -> Column:
    """How much smaller an error is than the baseline's, in percent; 0 for a zero baseline."""
    return F.when(baseline > 0, (baseline - value) / F.nullif(baseline, F.lit(0.0)) * 100).otherwise(F.lit(0.0))


def holdout_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", keys: Sequence[str] = ()
) -> DataFrame:
    a, p = col(actual), col(predicted)
    return df.groupBy(*key_columns(keys)).agg(
        F.count(F.lit(1)).alias("n"), rmse(a, p).alias("rmse"), mae(a, p).alias("mae"), mape(a, p).alias("mape")
    )


def split_rows(
    df: DataFrame,
    datetime_column: str,
    target: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    train_fraction: float = 0.8,
    strategy: str = "banded",
    bands: int | None = None,
) -> DataFrame:
    """Rows with a value, their position ``idx``, series length ``total`` and ``n_train``."""
    values = df.where(col(target).isNotNull() & col(datetime_column).isNotNull())
    indexed = sequence(values, [datetime_column, *tiebreak], keys, strategy, bands).with_index("idx", "total")
    return indexed.withColumn("n_train", F.floor(F.col("total") * F.lit(float(train_fraction))))


def holdout_predictions(
    df: DataFrame,
    datetime_column: str,
    target: str,
    keys: Sequence[str] = (),
    models: Sequence[str] = ("naive", "linear"),
    tiebreak: Sequence[str] = (),
    train_fraction: float = 0.8,
    min_rows: int = MIN_EVALUATION_ROWS,
    span: float = DEFAULT_SPAN,
    strategy: str = "banded",
    bands: int | None = None,
    gap: int = 0,
) -> DataFrame:
    """Long table of test rows: keys, time, ``actual``, ``model``, ``predicted``, ``total``.

    Every series is split and fitted on its own; the test starts ``gap`` rows after the
    training part. Series under ``min_rows`` give no rows, ``series_status`` names them.
    """
    unknown = [m for m in models if m not in BASELINES]
    if unknown:
        raise ValueError(f"not closed-form models: {unknown}")
    rows = split_rows(df, datetime_column, target, keys, tiebreak, train_fraction, strategy, bands).where(
        F.col("total") >= min_rows
    )
    train = rows.where(F.col("idx") < F.col("n_train"))
    fitted = fit_baselines(train.drop("n_train"), target, keys, "idx", F.floor(F.col("total") * F.lit(float(train_fraction))), span)
    values = [c for c in fitted.columns if c not in (*keys, "n_train")]
    test = attach(rows.where(F.col("idx") >= F.col("n_train") + gap), fitted, keys, values)
    made = [F.struct(F.lit(m).alias("model"), baseline_prediction(m, F.col("idx")).alias("predicted")) for m in models]
    return test.select(
        *key_columns(keys),
        col(datetime_column),
        *[col(t) for t in tiebreak],
        "total",
        col(target).cast("double").alias("actual"),
        F.explode(F.array(*made)).alias("__m"),
    ).select("*", "__m.model", "__m.predicted").drop("__m")


def series_status(
    df: DataFrame, target: str, keys: Sequence[str] = (), min_rows: int = MIN_EVALUATION_ROWS
) -> DataFrame:
    """Keys, rows with a value and whether the series is ``evaluated`` or ``too short`` for a holdout."""
    n = F.count(col(target))
    return df.groupBy(*key_columns(keys)).agg(
        n.alias("n_rows"), F.when(n >= min_rows, "evaluated").otherwise("too short").alias("status")
    )


def matched_predictions(
    test: DataFrame, models: Sequence[str], datetime_column: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Only the test rows that every one of ``models`` predicts, so that errors compare like with like."""
    entry = F.struct("model", "actual", "predicted")
    rows = test.where(F.col("model").isin(*models) & F.col("predicted").isNotNull())
    packed = rows.groupBy(*key_columns(keys), col(datetime_column)).agg(F.collect_list(entry).alias("__m"))
    whole = packed.where(F.size(F.array_distinct(F.transform("__m", lambda m: m["model"]))) == len(set(models)))
    return whole.select(*key_columns(keys), col(datetime_column), F.inline("__m"))


def evaluate_models(
    df: DataFrame,
    datetime_column: str,
    target: str,
    keys: Sequence[str] = (),
    models: Sequence[str] = ("naive", "linear"),
    test_fraction: float = 0.2,
    strategy: str = "banded",
    extra: DataFrame | None = None,
) -> DataFrame:
    """RMSE, MAE and MAPE per model on the last part; a panel is summed per time first.

    ``extra`` may hold further test predictions (``actual``, ``model``, ``predicted``).
    """
    flat = panel_total(df, datetime_column, target) if keys else df
    rows = holdout_predictions(flat, datetime_column, target, (), models, (), 1 - test_fraction, strategy=strategy)
    rows = rows.select("model", "actual", "predicted")
    if extra is not None:
        rows = rows.unionByName(extra.select("model", "actual", "predicted"))
    return holdout_metrics(rows, keys=["model"])


def usable_rmse(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def leaderboard(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Models by holdout RMSE with their gain over naive; unusable errors come last.

    One row per key and model, so a window per key sees only the few models.
    """
    by = key_columns(keys) or [F.lit(1)]
    score = F.when(usable_rmse(F.col("rmse")), F.col("rmse"))
    ranked = metrics.withColumn("__score", score)
    w = Window.partitionBy(*by)
    naive = F.max(F.when(F.col("model") == "naive", F.col("__score"))).over(w)
    gain = F.when(naive > 0, (1 - F.col("__score") / F.nullif(naive, F.lit(0.0))) * 100).otherwise(F.lit(0.0))
    place = F.row_number().over(w.orderBy(F.col("__score").asc_nulls_last(), F.col("model")))
    return ranked.withColumns({"rank": place, "improvement_pct": F.coalesce(gain, F.lit(0.0))}).drop("__score")


def best_model(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Model with the smallest usable RMSE per key."""
    usable = metrics.where(usable_rmse(F.col("rmse")))
    best = F.min_by(F.struct("model", "rmse"), F.struct("rmse", "model"))
    return usable.groupBy(*key_columns(keys)).agg(best.alias("b")).select(
        *key_columns(keys), F.col("b.model").alias("best_model"), F.col("b.rmse").alias("best_rmse")
    )


# -- choice rules ---------------------------------------------------------------------


def auto_model(n: Column) -> Column:
    return F.when(n >= 100, "boosted").when(n < 30, "naive").otherwise("linear")


def select_model(
    n_rows: Column, has_seasonality: Column, has_holidays: Column, has_groups: Column
) -> Column:
    """First rule that holds: short, seasonal with holidays, panel, long seasonal, default."""
    return (
        F.when(n_rows < 100, "simple_ewm")
        .when(has_seasonality & has_holidays, "seasonal")
        .when(has_groups, "boosted_global")
        .when(has_seasonality & (n_rows >= 200), "seasonal")
        .otherwise("boosted")
    )


# The models a recommendation ranks, in order of preference on equal scores.
RECOMMENDABLE = ("boosted", "linear", "seasonal", "naive")


def recommend_model(
    analyses: DataFrame, available: Sequence[str] = RECOMMENDABLE, frequency: str | None = None
) -> DataFrame:
    """Additive scores on rows with ``n_rows, n_groups, outliers_pct``; one row per model.

    Keeps the other columns of ``analyses`` and adds ``model, score, rank, reasons``.
    """
    n, groups = F.col("n_rows"), F.coalesce(F.col("n_groups"), F.lit(1))
    outliers = F.coalesce(F.col("outliers_pct"), F.lit(0.0))
    calendar = F.lit(frequency in ("D", "W", "M"))
    always = F.lit(True)
    rules: dict[str, list[tuple[Column, int, str]]] = {
        "boosted": [
            (n >= 100, 3, "enough rows"),
            (groups > 1, 2, "shares patterns across series"),
            (outliers > 2, 1, "robust to outliers"),
            (always, 2, "flexible"),
        ],
        "linear": [
            (n < 100, 3, "simple model for few rows"),
            (outliers < 2, 1, "clean data"),
            (always, 1, "interpretable"),
        ],
        "seasonal": [
            (calendar, 2, "calendar frequency"),
            (groups <= 1, 1, "single series"),
            (always, 1, "seasonality and holidays built in"),
        ],
        "naive": [(always, 0, "benchmark")],
    }
    cells = []
    for place, model in enumerate(m for m in RECOMMENDABLE if m in available):
        score = reduce(lambda a, b: a + b, [F.when(c, F.lit(s)).otherwise(F.lit(0)) for c, s, _ in rules[model]])
        reasons = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, _, text in rules[model]]))
        # Sorting on (-score, preference) gives the rank inside the array.
        cells.append(
            F.struct((-score).alias("s"), F.lit(place).alias("p"), F.lit(model).alias("model"), reasons.alias("reasons"))
        )
    ranked = analyses.withColumn("__c", F.array_sort(F.array(*cells)))
    return ranked.select(
        *[col(c) for c in analyses.columns], F.posexplode("__c").alias("__r", "__m")
    ).select(
        *[col(c) for c in analyses.columns],
        F.col("__m.model").alias("model"),
        (-F.col("__m.s")).alias("score"),
        (F.col("__r") + 1).alias("rank"),
        F.col("__m.reasons").alias("reasons"),
    )
