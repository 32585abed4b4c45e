"""End-to-end forecasting: profile, prepare, features, train, choose, forecast, diagnose.

The driver only reads one small profile row, one leaderboard and two numbers; every
series is processed by the same distributed plans.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.diagnostics.health import diagnose, forecast_sanity
from tidemark.functions.columns import col, is_non_negative_name, is_numeric, numeric_columns, require
from tidemark.models.baseline import BASELINES, default_span
from tidemark.models.boosted import (
    MIN_TUNING_ROWS,
    BoostedConfig,
    holdout_boosted,
    tune_boosted,
)
from tidemark.models.evaluate import (
    MIN_EVALUATION_ROWS,
    holdout_metrics,
    holdout_predictions,
    leaderboard,
    matched_predictions,
    series_status,
)
from tidemark.models.seasonal import holdout_seasonal
from tidemark.models.stored import ModelSettings, StoredModel, fit_model
from tidemark.operators.features import EWM_ROWS, configure_features
from tidemark.operators.fill import fix_frequency
from tidemark.operators.join import join_external
from tidemark.operators.prepare import apply_preparation, auto_clip
from tidemark.operators.profile import (
    PreparationStep,
    data_quality,
    infer_frequency,
    suggest_preparations,
    wizard_analysis,
)
from tidemark.operators.project import drop_non_numeric_target
from tidemark.operators.aggregate import dedup_mean
from tidemark.session import materialize

MODELS = (*BASELINES, "boosted", "seasonal")
STAGES = ("analysis", "preparation", "features", "training", "evaluation", "forecast")


@dataclass
class Step:
    name: str
    status: str
    seconds: float
    message: str


@dataclass
class WorkflowResult:
    steps: list[Step] = field(default_factory=list)
    analysis: dict[str, Any] = field(default_factory=dict)
    preparation: list[PreparationStep] = field(default_factory=list)
    prepared: DataFrame | None = None
    features: dict[str, Any] = field(default_factory=dict)
    metrics: DataFrame | None = None
    best_model: str | None = None
    best_params: dict[str, Any] = field(default_factory=dict)
    forecast: DataFrame | None = None
    diagnostics: DataFrame | None = None
    model: StoredModel | None = None
    series: DataFrame | None = None

    @property
    def success(self) -> bool:
        return self.forecast is not None


@dataclass(frozen=True)
class Job:
    """What to forecast. ``frequency=None`` is inferred from the data."""

    datetime_column: str
    target: str
    horizon: int
    frequency: str | None = None
    keys: tuple[str, ...] = ()
    gap: int = 0
    model: str = "auto"
    exog: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)
    tune: bool = False
    ewm_rows: int = EWM_ROWS
    min_tuning_rows: int = MIN_TUNING_ROWS
    strategy: str = "banded"


def series_frequency(df: DataFrame, job: Job) -> str:
    """The given frequency, or the most common one among the series (daily if none)."""
    if job.frequency:
        return job.frequency
    found = infer_frequency(df, job.datetime_column, job.keys, strategy=job.strategy)
    top = found.where("frequency IS NOT NULL").groupBy("frequency").count()
    row = top.orderBy(F.col("count").desc(), "frequency").first()
    return row["frequency"] if row else "D"


def forecast_with(
    prepared: DataFrame, job: Job, model: str, frequency: str, features: Mapping[str, Any],
    holidays: DataFrame | None = None, future_exog: DataFrame | None = None, span: int = 20,
) -> tuple[DataFrame, StoredModel]:
    """Fit one model on everything and predict the horizon."""
    settings = ModelSettings(
        model, job.datetime_column, job.target, job.horizon, frequency, tuple(job.keys), job.gap, span, job.strategy
    )
    boosted = boosted_config(job, frequency, features) if model == "boosted" else None
    fitted = fit_model(prepared, settings, boosted, holidays=holidays)
    return fitted.predict(future_exog=future_exog, holidays=holidays), fitted


def boosted_config(job: Job, frequency: str, features: Mapping[str, Any]) -> BoostedConfig:
    return BoostedConfig(
        job.datetime_column, job.target, job.horizon, frequency, tuple(job.keys), job.gap,
        tuple(features["lags"]), tuple(features["rolling_windows"]), tuple(features["date_features"]),
        bool(features["use_ewm"]), tuple(job.exog), dict(job.params),
    )


def holdout_of(
    prepared: DataFrame, job: Job, models: Sequence[str], frequency: str, features: Mapping[str, Any],
    holidays: DataFrame | None = None, span: int = 20,
) -> DataFrame:
    """Test rows of every candidate in one long table: keys, time, ``actual, model, predicted``.

    All start ``job.gap`` after the training part; only rows that every candidate predicts stay.
    """
    out: DataFrame | None = None
    closed = [m for m in models if m in BASELINES]
    if closed:
        out = holdout_predictions(
            prepared, job.datetime_column, job.target, job.keys, closed, span=span, strategy=job.strategy,
            gap=job.gap,
        ).drop("total")
    if "seasonal" in models:
        part = holdout_seasonal(
            prepared, job.datetime_column, job.target, frequency, job.keys, holidays=holidays, strategy=job.strategy,
            gap=job.gap,
        )
        out = part if out is None else out.unionByName(part)
    if "boosted" in models:
        part = holdout_boosted(prepared, boosted_config(job, frequency, features), strategy=job.strategy)
        part = part.where(F.col("predicted").isNotNull())
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no candidate models")
    return matched_predictions(out, models, job.datetime_column, job.keys)


def diagnose_forecast(
    source: DataFrame, test: DataFrame, forecast: DataFrame, job: Job, best: str, as_of: Column
) -> DataFrame:
    """Residual, baseline, quality, sanity and health results per series.

    The chosen model and naive are compared on the test rows both of them have.
    """
    keys = list(job.keys)
    by = [*[col(k) for k in keys], col(job.datetime_column)]
    pairs = test.groupBy(*by).agg(
        F.max("actual").alias("actual"),
        F.max(F.when(F.col("model") == best, F.col("predicted"))).alias("predicted"),
        F.max(F.when(F.col("model") == "naive", F.col("predicted"))).alias("naive"),
    ).where(F.col("predicted").isNotNull() & F.col("naive").isNotNull())
    quality = data_quality(source, job.datetime_column, job.target, as_of, keys)
    sanity = forecast_sanity(forecast, source, job.datetime_column, job.target, keys)
    return diagnose(pairs, quality, sanity, job.datetime_column, keys, job.strategy)


def run_workflow(
    df: DataFrame,
    job: Job,
    as_of: Column,
    holidays: DataFrame | None = None,
    future_exog: DataFrame | None = None,
    external: tuple[DataFrame, str] | None = None,
    store: str | None = None,
) -> WorkflowResult:
    """All six stages. A panel is trained with the global model next to the naive baseline.

    With ``store``, a new folder, the steps, the forecast and the model are written below it;
    a stage that fails leaves a ``failed`` step there.
    """
    result = WorkflowResult()
    begun = time.monotonic()
    try:
        _run_stages(result, df, job, as_of, holidays, future_exog, external)
        if store and result.forecast is not None:
            result.forecast.write.parquet(f"{store}/forecast")
            result.model.save(f"{store}/model")
    except Exception as error:
        result.steps.append(Step(STAGES[min(len(result.steps), len(STAGES) - 1)], "failed", time.monotonic() - begun, str(error)[:500]))
        raise
    finally:
        if store and result.steps:
            rows = [(i, s.name, s.status, s.seconds, s.message) for i, s in enumerate(result.steps)]
            steps = df.sparkSession.createDataFrame(rows, "position int, name string, status string, seconds double, message string")
            steps.coalesce(1).write.parquet(f"{store}/steps")
    return result


def _run_stages(
    result: WorkflowResult,
    df: DataFrame,
    job: Job,
    as_of: Column,
    holidays: DataFrame | None,
    future_exog: DataFrame | None,
    external: tuple[DataFrame, str] | None,
) -> None:
    require(df, job.datetime_column, job.target, *job.keys)
    if job.model not in ("auto", *MODELS):
        raise ValueError(f"unknown model {job.model!r}; use auto or one of {MODELS}")
    clock = time.monotonic()

    def done(name: str, message: str) -> None:
        nonlocal clock
        now = time.monotonic()
        result.steps.append(Step(name, "done", now - clock, message))
        clock = now

    if external is not None:
        df = join_external(df, external[0], job.datetime_column, external[1])
    keys = list(job.keys)
    needed = [*keys, job.datetime_column, job.target, *job.exog]
    source = df.select(*[col(c) for c in dict.fromkeys(needed)])
    source = source.where(col(job.datetime_column).isNotNull())
    if not is_numeric(source.schema[job.target].dataType):
        # What does not read as a number is a missing value of the series.
        source = source.withColumn(job.target, col(job.target).try_cast("double"))
    analysed = wizard_analysis(source, job.datetime_column, job.target, as_of, keys, strategy=job.strategy)
    result.analysis = analysed.first().asDict(recursive=True)
    result.analysis["potential_exog"] = numeric_columns(df, {job.datetime_column, job.target, *keys})
    frequency = series_frequency(source, job)
    result.analysis["frequency"] = frequency
    done("analysis", f"{result.analysis['n_rows']} rows, {result.analysis['n_groups']} series, frequency {frequency}")

    result.preparation = suggest_preparations(result.analysis)
    prepared = apply_preparation(
        source, result.preparation, job.datetime_column, job.target, frequency, keys, strategy=job.strategy
    )
    if is_non_negative_name(job.target) and result.analysis["negative_pct"] > 0:
        prepared = auto_clip(prepared, job.target)
    # Every later stage reads the prepared panel; write it once.
    result.prepared = prepared = materialize(prepared, "prepared")
    done("preparation", ", ".join(f"{s.id}={s.choice}" for s in result.preparation if s.enabled) or "nothing to do")

    smallest = result.analysis["min_group_size"]
    result.features = features = configure_features(frequency, job.gap, result.analysis["n_rows"], smallest, job.ewm_rows)
    done("features", f"lags {features['lags']}, windows {features['rolling_windows']}")

    if job.model != "auto":
        candidates = list(dict.fromkeys(["naive", job.model]))
    elif keys:
        candidates = ["naive", "boosted"]
    else:
        candidates = ["naive", "linear", "boosted"]
    if result.analysis["max_group_size"] < MIN_EVALUATION_ROWS:
        raise ValueError(f"no series has the {MIN_EVALUATION_ROWS} rows an evaluation needs")
    result.series = series_status(prepared, job.target, keys)
    span = default_span(result.analysis["median_group_size"])
    test = materialize(holdout_of(prepared, job, candidates, frequency, features, holidays, span), "holdout")
    metrics = holdout_metrics(test, keys=["model"])
    if job.tune and "boosted" in candidates and result.analysis["n_rows"] >= job.min_tuning_rows:
        # The job's own setting is one of the tried, so all errors are of the same rows.
        result.best_params, _ = tune_boosted(prepared, boosted_config(job, frequency, features), strategy=job.strategy)
    done("training", ", ".join(candidates))

    result.metrics = board = leaderboard(metrics)
    allowed = [job.model] if job.model != "auto" else candidates
    row = board.where(F.col("model").isin(*allowed)).orderBy("rank").first()
    result.best_model = row["model"] if row else allowed[0]
    done("evaluation", f"best {result.best_model}")

    final = Job(**{**job.__dict__, "params": {**job.params, **result.best_params}})
    result.forecast, result.model = forecast_with(
        prepared, final, result.best_model, frequency, features, holidays, future_exog, span
    )
    result.diagnostics = diagnose_forecast(source, test, result.forecast, job, result.best_model, as_of)
    done("forecast", f"{job.horizon} steps per series")


def forecast(
    df: DataFrame, job: Job, as_of: Column, holidays: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Forecast with the named model, or by series length for ``auto``, and its diagnostics.

    Duplicate times are averaged and gaps filled first, so that rows are periods.
    """
    keys = list(job.keys)
    frequency = series_frequency(df, job)
    values = drop_non_numeric_target(
        df.select(*[col(k) for k in keys], col(job.datetime_column), col(job.target)), job.target, job.datetime_column
    )
    panel = materialize(
        fix_frequency(dedup_mean(values, job.datetime_column, keys), job.datetime_column, frequency, keys, strategy=job.strategy), "panel"
    )
    longest = panel.groupBy(*[col(k) for k in keys]).count().agg(F.max("count"), F.min("count"), F.sum("count")).first()
    if not longest[0]:
        raise ValueError("no usable rows")
    model = job.model
    if model == "auto":
        model = "boosted" if longest[0] >= 100 else "naive" if longest[0] < 30 else "linear"
    features = configure_features(frequency, job.gap, longest[2], longest[1], job.ewm_rows)
    test = holdout_of(panel, job, list(dict.fromkeys(["naive", model])), frequency, features, holidays)
    made, _ = forecast_with(panel, job, model, frequency, features, holidays)
    return made, diagnose_forecast(panel, materialize(test, "holdout"), made, job, model, as_of)


def predict_existing(
    model: StoredModel, df: DataFrame | None = None, horizon: int | None = None,
    future_exog: DataFrame | None = None, holidays: DataFrame | None = None,
) -> DataFrame:
    """Predict again with a reloaded model of any kind: after its stored state, or after the rows of ``df``."""
    return (model if df is None else model.moved_to(df)).predict(horizon, future_exog, holidays)
