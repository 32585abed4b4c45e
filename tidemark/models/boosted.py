"""One gradient-boosted model for all series, forecasting every step directly.

The step number is a feature, so a single ``transform`` predicts the whole horizon and
no prediction feeds the next one. Training rows come from one ordered pass: each row is
an origin that sees its own past and the following ``horizon`` values as labels.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import date_part
from tidemark.functions.columns import col
from tidemark.functions.frequency import shift_periods
from tidemark.operators.join import join_future_exog
from tidemark.operators.keys import attach, key_columns
from tidemark.operators.sequence import sequence
from tidemark.operators.series import ewm_mean
from tidemark.session import materialize, point_checkpoints

# The most rounds and the step sizes of four tried settings. Depths hold 32, 64, 128 and 32 leaves.
TUNING_GRID: tuple[dict[str, Any], ...] = (
    {"maxIter": 200, "stepSize": 0.1, "maxDepth": 5},
    {"maxIter": 800, "stepSize": 0.03, "maxDepth": 6},
    {"maxIter": 1000, "stepSize": 0.01, "maxDepth": 7},
    {"maxIter": 300, "stepSize": 0.08, "maxDepth": 5, "subsamplingRate": 0.7},
)
#: Rounds of a setting's first fit when its best number of rounds is searched.
FIRST_ROUNDS = 25
DEFAULT_PARAMS: dict[str, Any] = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, "seed": 42}
MIN_TUNING_ROWS = 500
EWM_ALPHA = 0.3


@dataclass(frozen=True)
class BoostedConfig:
    datetime_column: str
    target: str
    horizon: int
    frequency: str = "D"
    keys: tuple[str, ...] = ()
    gap: int = 0
    lags: tuple[int, ...] = (1, 7, 14)
    rolling_windows: tuple[int, ...] = (7, 14)
    date_features: tuple[str, ...] = ("day_of_week", "month", "day_of_year")
    use_ewm: bool = False
    exog: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)

    def feature_names(self) -> list[str]:
        names = [f"lag_{k}" for k in self.lags]
        for w in self.rolling_windows:
            names += [f"rolling_mean_{w}", f"rolling_std_{w}"]
        if self.use_ewm:
            names.append("ewm")
        return [*names, *self.date_features, *self.exog, "step"]


def _origin_features(c: BoostedConfig, steps: int) -> tuple[dict[str, Any], int, int]:
    """Window features of an origin row, their lookback and their lookahead.

    A lag counts from the first forecast step, so lag ``gap + 1`` is the origin's own value.
    """
    value = lambda: col(c.target).cast("double")
    made: dict[str, Any] = {}
    lookback = 0
    for k in c.lags:
        offset = max(0, k - c.gap - 1)
        # A series shorter than the lag falls back on its latest value.
        made[f"lag_{k}"] = lambda w, o=offset: F.coalesce(F.lag(value(), o).over(w), value())
        lookback = max(lookback, offset)
    for n in c.rolling_windows:
        made[f"rolling_mean_{n}"] = lambda w, n=n: F.avg(value()).over(w.rowsBetween(1 - n, 0))
        made[f"rolling_std_{n}"] = lambda w, n=n: F.coalesce(
            F.stddev_samp(value()).over(w.rowsBetween(1 - n, 0)), F.lit(0.0)
        )
        lookback = max(lookback, n - 1)
    ahead = [col(c.datetime_column).alias("ds"), value().alias("label")]
    ahead += [col(x).cast("double").alias(x) for x in c.exog]
    made["__ahead"] = lambda w: F.collect_list(F.struct(*ahead)).over(w.rowsBetween(c.gap + 1, c.gap + steps))
    made["__is_last"] = lambda w: F.lead(F.lit(1)).over(w).isNull()
    return made, lookback, c.gap + steps


def origins(df: DataFrame, c: BoostedConfig, steps: int, strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Every row with a value as a possible forecast origin, with its features and next rows."""
    rows = df.where(col(c.target).isNotNull() & col(c.datetime_column).isNotNull())
    if c.use_ewm:
        rows = ewm_mean(rows, c.target, c.datetime_column, c.keys, EWM_ALPHA, output="ewm", strategy=strategy, bands=bands)
    made, lookback, lookahead = _origin_features(c, steps)
    ordered = sequence(rows, c.datetime_column, c.keys, strategy, bands)
    return ordered.over(made, lookback, lookahead)


def last_origins(df: DataFrame, c: BoostedConfig, strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """One row per series: its last time as ``__last`` and the features that a forecast starts from."""
    last = origins(df, c, 1, strategy, bands).where("__is_last")
    return last.select(*key_columns(c.keys), col(c.datetime_column).alias("__last"), *_origin_columns(c))


def _with_step_features(rows: DataFrame, c: BoostedConfig) -> DataFrame:
    parts = {p: date_part(F.col("ds"), p).cast("double") for p in c.date_features}
    return rows.withColumns({**parts, "step": F.col("step").cast("double")})


def _origin_columns(c: BoostedConfig) -> list[Column]:
    fixed = {*c.date_features, *c.exog, "step"}
    return [F.col(n) for n in c.feature_names() if n not in fixed]


def labelled_rows(found: DataFrame, c: BoostedConfig, condition: Column | None = None) -> DataFrame:
    """One row per origin and known step: features, ``ds`` and ``label``."""
    source = found if condition is None else found.where(condition)
    exploded = source.select(
        *key_columns(c.keys), *_origin_columns(c), F.posexplode("__ahead").alias("__i", "__a")
    ).select(
        *key_columns(c.keys), *_origin_columns(c), (F.col("__i") + 1).alias("step"),
        F.col("__a.ds").alias("ds"), F.col("__a.label").alias("label"),
        *[F.coalesce(F.col(f"__a.{x}"), F.lit(0.0)).alias(x) for x in c.exog],
    )
    return _with_step_features(exploded, c)


def _assembler(c: BoostedConfig) -> VectorAssembler:
    return VectorAssembler(inputCols=c.feature_names(), outputCol="features", handleInvalid="keep")


def feature_vectors(rows: DataFrame, c: BoostedConfig) -> DataFrame:
    """``features`` and ``label`` of the labelled rows; boosting reads them many times, so they are written."""
    needed = rows.select(*[F.col(n).cast("double").alias(n) for n in c.feature_names()], "label").where(
        F.col("label").isNotNull()
    )
    return materialize(_assembler(c).transform(needed).select("features", "label"), "boosting")


def _boost(vectors: DataFrame, params: Mapping[str, Any]) -> GBTRegressionModel:
    # Long fits cut their lineage every ten rounds (checkpointInterval) in the shared folder.
    point_checkpoints(vectors.sparkSession)
    made = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", **{**DEFAULT_PARAMS, **params})
    return made.fit(vectors)


def fit_rows(rows: DataFrame, c: BoostedConfig) -> PipelineModel:
    return PipelineModel(stages=[_assembler(c), _boost(feature_vectors(rows, c), c.params)])


@dataclass(frozen=True)
class BoostedModel:
    config: BoostedConfig
    pipeline: PipelineModel

    def predict(
        self, df: DataFrame, horizon: int | None = None, future_exog: DataFrame | None = None,
        strategy: str = "banded", bands: int | None = None,
    ) -> DataFrame:
        """Keys, ``step``, ``ds``, ``prediction`` after the last row of every series."""
        return self.predict_from(last_origins(df, self.config, strategy, bands), horizon, future_exog)

    def predict_from(self, last: DataFrame, horizon: int | None = None, future_exog: DataFrame | None = None) -> DataFrame:
        """The same from the rows of ``last_origins``; their order does not matter."""
        c = self.config
        h = horizon or c.horizon
        steps = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")
        grid = last.select(*key_columns(c.keys), *_origin_columns(c), F.col("__last"), steps)
        grid = grid.withColumn("ds", shift_periods(F.col("__last"), F.col("step") + c.gap, c.frequency))
        if c.exog:
            if future_exog is None:
                raise ValueError(f"future values needed for {c.exog}")
            renamed = future_exog.withColumnRenamed(c.datetime_column, "ds")
            keys = [k for k in c.keys if k in renamed.columns]
            grid = join_future_exog(grid, renamed, "ds", keys, c.exog).fillna(0.0, list(c.exog))
        scored = self.pipeline.transform(_with_step_features(grid, c))
        return scored.select(
            *key_columns(c.keys), F.col("step").cast("int").alias("step"), "ds", "prediction",
            F.lit("boosted").alias("model_name"),
        )

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        text = json.dumps(asdict(self.config))
        spark.createDataFrame([(text,)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        raw = json.loads(spark.read.schema("config string").json(f"{path}/config").first()[0])
        config = BoostedConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        return BoostedModel(config, PipelineModel.load(f"{path}/model"))


def fit_boosted(df: DataFrame, c: BoostedConfig, strategy: str = "banded", bands: int | None = None) -> BoostedModel:
    rows = labelled_rows(origins(df, c, c.horizon, strategy, bands), c)
    return BoostedModel(c, fit_rows(rows, c))


@dataclass(frozen=True)
class Holdout:
    """What every setting is fitted and tested on: written once, whatever is tried."""

    training: DataFrame
    test: DataFrame


def holdout_tables(
    df: DataFrame, c: BoostedConfig, train_fraction: float = 0.8, strategy: str = "banded", bands: int | None = None,
    min_rows: int = 20,
) -> Holdout:
    """Labelled rows inside the training part of each series, and all rows from ``gap`` past it.

    A test row sees the features of the last training row and its own step, however far
    past the split it lies.
    """
    rows = df.where(col(c.target).isNotNull() & col(c.datetime_column).isNotNull())
    indexed = sequence(rows, c.datetime_column, c.keys, strategy, bands).with_index("__idx", "__total").where(
        F.col("__total") >= min_rows
    )
    n_train = F.floor(F.col("__total") * F.lit(float(train_fraction)))
    placed = indexed.withColumn("__n_train", n_train)
    found = materialize(origins(placed, c, c.horizon, strategy, bands), "origins")
    # Label i of an origin lies gap + 1 + i rows after it.
    known = F.col("__n_train") - F.col("__idx") - 1 - c.gap
    inside = found.where(known > 0).withColumn("__ahead", F.slice("__ahead", F.lit(1), F.least(known, F.lit(c.horizon)).cast("int")))
    at_split = found.where(F.col("__idx") == F.col("__n_train") - 1).select(*key_columns(c.keys), *_origin_columns(c))
    names = [n for n in c.feature_names() if n not in {*c.date_features, *c.exog, "step"}]
    later = found.where(F.col("__idx") >= F.col("__n_train") + c.gap).select(
        *key_columns(c.keys), (F.col("__idx") - F.col("__n_train") - c.gap + 1).alias("step"),
        col(c.datetime_column).alias("ds"), col(c.target).cast("double").alias("label"),
        *[F.coalesce(col(x).cast("double"), F.lit(0.0)).alias(x) for x in c.exog],
    )
    test = _with_step_features(attach(later, at_split, c.keys, names), c)
    return Holdout(labelled_rows(inside, c), test)


def holdout_boosted(
    df: DataFrame, c: BoostedConfig, train_fraction: float = 0.8, strategy: str = "banded", bands: int | None = None,
    name: str = "boosted", min_rows: int = 20, tables: Holdout | None = None,
) -> DataFrame:
    """Test predictions of all rows past the split of each series, fitted on labels inside its training part."""
    held = tables or holdout_tables(df, c, train_fraction, strategy, bands, min_rows)
    scored = fit_rows(held.training, c).transform(held.test)
    return scored.select(
        *key_columns(c.keys), F.col("ds").alias(c.datetime_column), F.col("label").alias("actual"),
        F.lit(name).alias("model"), F.col("prediction").alias("predicted"),
    )


@dataclass(frozen=True)
class Trial:
    """One setting: ``curve[i]`` is the RMSE on the test rows after ``i + 1`` rounds of a single fit."""

    setting: Mapping[str, Any]
    curve: tuple[float, ...]

    @property
    def rounds(self) -> int:
        return min(range(len(self.curve)), key=self.curve.__getitem__) + 1

    @property
    def rmse(self) -> float:
        return self.curve[self.rounds - 1]

    @property
    def params(self) -> dict[str, Any]:
        """The setting with the number of rounds that its curve asks for."""
        return {**self.setting, "maxIter": self.rounds}


def rounds_curve(
    training: DataFrame, test: DataFrame, params: Mapping[str, Any], first_rounds: int = FIRST_ROUNDS
) -> tuple[float, ...]:
    """Test RMSE after each round, from feature vectors of both sides.

    The rounds of a fit are a prefix of those of a longer one, so one fit gives the
    whole curve in one pass over the test rows. Fits double their rounds up to
    ``maxIter`` while the best round lies in the second half of the curve; a setting
    is done when as many rounds again have brought nothing.
    """
    most = {**DEFAULT_PARAMS, **params}["maxIter"]
    rounds = min(first_rounds, most)
    while True:
        model = _boost(training, {**params, "maxIter": rounds})
        curve = tuple(math.sqrt(e) for e in model.evaluateEachIteration(test, "squared"))
        best = curve.index(min(curve)) + 1
        if rounds == most or 2 * best <= rounds:
            return curve
        rounds = min(2 * rounds, most)


def tried_settings(
    df: DataFrame, c: BoostedConfig, grid: Sequence[Mapping[str, Any]] = TUNING_GRID,
    train_fraction: float = 0.8, strategy: str = "banded", first_rounds: int = FIRST_ROUNDS,
) -> list[Trial]:
    """Every setting with its error curve over all series together, on the same written rows."""
    held = holdout_tables(df, c, train_fraction, strategy)
    training, test = feature_vectors(held.training, c), feature_vectors(held.test, c)
    if training.isEmpty() or test.isEmpty():
        return []
    return [Trial(dict(p), rounds_curve(training, test, {**c.params, **p}, first_rounds)) for p in grid]


def tune_boosted(
    df: DataFrame, c: BoostedConfig, grid: Sequence[Mapping[str, Any]] = TUNING_GRID,
    train_fraction: float = 0.8, strategy: str = "banded", first_rounds: int = FIRST_ROUNDS,
) -> tuple[dict[str, Any], float]:
    """The setting, rounds included, with the smallest holdout RMSE, and that RMSE.

    The configured setting itself is tried first, so a winner is better on the same rows.
    """
    tried = tried_settings(df, c, ({}, *grid), train_fraction, strategy, first_rounds)
    if not tried:
        raise ValueError("no series long enough to tune on")
    best = min(tried, key=lambda t: t.rmse)
    return best.params, best.rmse
