"""One saved form for all models: settings, what was learned, and one state row per series.

A forecast is made from the state alone, so a reloaded model predicts without the
rows it was fitted on; with newer rows its state moves on and what it learned stays.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.models.baseline import BASELINES, DEFAULT_SPAN, fit_all_rows, predict_baseline
from tidemark.models.boosted import BoostedConfig, BoostedModel, fit_boosted, last_origins
from tidemark.models.seasonal import SeasonalConfig, fit_seasonal, predict_seasonal
from tidemark.operators.keys import key_columns
from tidemark.session import materialize

KINDS = (*BASELINES, "seasonal", "boosted")


@dataclass(frozen=True)
class ModelSettings:
    kind: str
    datetime_column: str
    target: str
    horizon: int
    frequency: str = "D"
    keys: tuple[str, ...] = ()
    gap: int = 0
    span: float = DEFAULT_SPAN
    strategy: str = "banded"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown model {self.kind!r}; use one of {KINDS}")


def _from_json(cls: type, values: Mapping[str, Any]) -> Any:
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


@dataclass(frozen=True)
class StoredModel:
    """``state`` has the keys and, by kind, coefficients (closed forms, seasonal) or last features (boosted)."""

    settings: ModelSettings
    state: DataFrame
    seasonal: SeasonalConfig | None = None
    boosted: BoostedModel | None = None
    last: DataFrame | None = None

    def predict(
        self, horizon: int | None = None, future_exog: DataFrame | None = None, holidays: DataFrame | None = None
    ) -> DataFrame:
        """Keys, ``step``, ``ds``, ``prediction``, ``model_name`` after the state of every series."""
        s = self.settings
        h = horizon or s.horizon
        if s.kind == "boosted":
            return self.boosted.predict_from(self.state, h, future_exog)
        if s.kind == "seasonal":
            if self.seasonal.with_holidays and holidays is None:
                raise ValueError("the model was fitted with holidays; they are needed again")
            return predict_seasonal(self.state, self.seasonal, h, s.frequency, s.keys, s.gap, holidays, self.last)
        return predict_baseline(self.state, h, s.kind, s.frequency, s.keys, s.gap)

    def moved_to(self, df: DataFrame) -> StoredModel:
        """The model after the rows of ``df``, which hold each series from its beginning.

        Boosted trees and seasonal coefficients stay and forecasts start after the new rows;
        a closed form is nothing but its state, which is computed again.
        """
        s = self.settings
        if s.kind == "boosted":
            return replace(self, state=materialize(last_origins(df, self.boosted.config, s.strategy), "state"))
        if s.kind == "seasonal":
            rows = df.where(col(s.target).isNotNull() & col(s.datetime_column).isNotNull())
            return replace(self, last=rows.groupBy(*key_columns(s.keys)).agg(F.max(col(s.datetime_column)).alias("end")))
        return replace(self, state=_baseline_state(df, s))

    def save(self, path: str) -> None:
        """Write below ``path``, which must be new. The settings come last: without them there is no model."""
        self.state.write.parquet(f"{path}/state")
        if self.last is not None:
            self.last.write.parquet(f"{path}/last")
        if self.boosted is not None:
            self.boosted.pipeline.write().save(f"{path}/trees")
        learned = self.boosted.config if self.boosted else self.seasonal
        text = json.dumps({
            "settings": asdict(self.settings), "learned": asdict(learned) if learned else None, "moved": self.last is not None,
        })
        spark = self.state.sparkSession
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> StoredModel:
        raw = json.loads(spark.read.text(f"{path}/settings").first()[0])
        settings = _from_json(ModelSettings, raw["settings"])
        state = spark.read.parquet(f"{path}/state")
        seasonal = boosted = None
        if settings.kind == "seasonal":
            seasonal = _from_json(SeasonalConfig, raw["learned"])
        if settings.kind == "boosted":
            boosted = BoostedModel(_from_json(BoostedConfig, raw["learned"]), PipelineModel.load(f"{path}/trees"))
        return StoredModel(settings, state, seasonal, boosted, spark.read.parquet(f"{path}/last") if raw["moved"] else None)


def _baseline_state(df: DataFrame, s: ModelSettings) -> DataFrame:
    return materialize(fit_all_rows(df, s.datetime_column, s.target, s.keys, span=s.span, strategy=s.strategy), "state")


def fit_model(
    df: DataFrame, settings: ModelSettings, boosted: BoostedConfig | None = None,
    seasonal: SeasonalConfig | None = None, holidays: DataFrame | None = None,
) -> StoredModel:
    """Fit a model of any kind on all rows; its state is written once."""
    s = settings
    if s.kind == "boosted":
        if boosted is None:
            raise ValueError("a boosted model needs its BoostedConfig")
        fitted = fit_boosted(df, boosted, s.strategy)
        return StoredModel(s, materialize(last_origins(df, boosted, s.strategy), "state"), boosted=fitted)
    if s.kind == "seasonal":
        c = seasonal or SeasonalConfig.for_frequency(s.frequency, holidays is not None)
        state = fit_seasonal(df, s.datetime_column, s.target, s.keys, c, holidays, s.strategy)
        return StoredModel(s, materialize(state, "state"), seasonal=c)
    return StoredModel(s, _baseline_state(df, s))
