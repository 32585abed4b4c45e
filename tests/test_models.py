"""Planted signals, short series, gaps, and whole runs."""

import math
import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.diagnostics import health
from tidemark.models import baseline, evaluate, seasonal
from tidemark.models.boosted import (
    BoostedConfig, BoostedModel, feature_vectors, fit_boosted, holdout_boosted, holdout_tables, rounds_curve,
    tried_settings, tune_boosted,
)
from tidemark.models.stored import KINDS, ModelSettings, StoredModel, fit_model
from tidemark.operators import features as fea
from tidemark.operators import profile as prf
from tidemark.operators import series as win
from tidemark.plans.workflow import Job, forecast, run_workflow
from tidemark.sources import sinks

START = datetime(2023, 1, 2)
SCHEMA = "k string, ds timestamp_ntz, v double"


def weekly(n, key="a", trend=0.0, noise=0.5, seed=1):
    rng = random.Random(seed)
    return [
        (key, START + timedelta(days=d), 100 + trend * d + 10 * math.sin(2 * math.pi * d / 7) + rng.gauss(0, noise))
        for d in range(n)
    ]


@pytest.fixture(scope="module")
def panel(spark):
    rows = weekly(200) + weekly(200, "b", trend=0.5, seed=2) + weekly(3, "tiny")
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def test_seasonality_and_trend_are_found_per_series(spark, panel):
    found = {r["k"]: r for r in win.seasonality(panel, "v", "ds", "D", ["k"], "keyed").collect()}
    assert found["a"]["seasonality_period"] == 7 and not found["tiny"]["has_seasonality"]
    trends = {r["k"]: r["has_trend"] for r in win.trend_concordance(panel, "v", "ds", ["k"], "keyed").collect()}
    assert trends == {"a": False, "b": True, "tiny": False}


@pytest.mark.parametrize("strategy", ["keyed", "banded"])
def test_acf_equals_numpy(spark, panel, strategy):
    x = np.array([v for _, _, v in weekly(200)])
    x = x - x.mean()
    lags = [1, 7, 30]
    row = win.autocorrelation(panel.where("k = 'a'"), "v", "ds", lags, strategy=strategy).first()
    scan = win.autocorrelation(panel.where("k = 'a'"), "v", "ds", range(2, 40), strategy=strategy).first()
    want = {k: float((x[k:] * x[:-k]).sum() / (x * x).sum()) for k in range(1, 40)}
    assert {a["lag"]: a["acf"] for a in row["acf"]} == pytest.approx({k: want[k] for k in lags})
    assert {a["lag"]: a["acf"] for a in scan["acf"]} == pytest.approx({k: want[k] for k in range(2, 40)})


def test_season_outside_the_candidates_is_scanned(spark):
    rows = [("a", START + timedelta(days=d), math.sin(2 * math.pi * d / 9)) for d in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    # No candidate of weekly data fits a wave of 9; lag 8 is the first above the threshold.
    for strategy in ("keyed", "banded"):
        assert win.seasonality(df, "v", "ds", "W", ["k"], strategy).first()["seasonality_period"] == 8


@pytest.mark.parametrize("n", [2500])
def test_trend_compares_all_pairs(spark, n):
    rows = spark.range(n).select(F.lit("a").alias("k"), F.col("id"), (F.col("id") % 17).cast("double").alias("v"))
    got = win.trend_concordance(rows, "v", "id", ["k"], "banded", bands=5, cell_rows=150).first()
    at = np.arange(n)
    v = (at % 17).astype(float)
    signs = np.sign(v[None, :] - v[:, None])[np.triu_indices(n, 1)]
    assert got["concordance"] == pytest.approx(signs.mean()) and got["n"] == n


def test_ewm_both_ways_equal_pandas(spark):
    import pandas as pd

    rng = random.Random(3)
    v = [rng.uniform(0, 10) for _ in range(900)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    want = pd.Series(v).ewm(span=9, adjust=False).mean().to_numpy()
    for strategy in ("keyed", "banded"):
        got = [r["ewm_mean"] for r in win.ewm_mean(df, "v", "i", span=9, strategy=strategy, bands=6).orderBy("i").collect()]
        assert got == pytest.approx(list(want), rel=1e-12)
        assert win.ewm_level(df, "v", "i", span=9, strategy=strategy, bands=6).first()[0] == pytest.approx(want[-1], rel=1e-12)


def test_features_do_not_leak_between_series(spark, panel):
    made = fea.create_features(panel, "ds", "v", [1], [3], keys=["k"], strategy="banded")
    starts = made.where("trend = 0").collect()
    assert len(starts) == 3 and all(r["lag_1"] is None and r["rolling_mean_3"] == r["v"] for r in starts)
    alone = fea.create_features(panel.where("k = 'b'"), "ds", "v", [1], [3], strategy="keyed").orderBy("ds").collect()
    together = made.where("k = 'b'").orderBy("ds").select(alone[0].__fields__).collect()
    for a, b in zip(alone, together):
        assert a["lag_1"] == b["lag_1"] and a["trend"] == b["trend"]
        assert a["rolling_mean_3"] == pytest.approx(b["rolling_mean_3"])


def test_feature_rules():
    assert fea.select_lags("D", 60) == [1, 7, 14]
    assert fea.select_lags("H", 1000) == [1, 24, 168]
    assert fea.select_rolling_windows("W", 20) == [4]
    assert fea.configure_features("15min", 0, 10**6)["lags"] == [1, 24, 48, 96, 672]
    assert fea.configure_features("D", 5, 10**6)["lags"] == [6, 13, 20, 34]
    short = fea.configure_features("D", 5, 12)
    assert min(short["lags"]) > 5
    with pytest.raises(ValueError):
        fea.FeatureSpec("x", "custom")


def test_baselines_on_short_series_and_gap(spark, panel):
    for model in baseline.BASELINES:
        made = baseline.forecast_baseline(panel, "ds", "v", 4, model, "D", ["k"], gap=2, strategy="banded")
        rows = made.orderBy("k", "step").collect()
        assert len(rows) == 12 and all(r["prediction"] is not None for r in rows)
        assert rows[0]["ds"] == START + timedelta(days=199 + 3)
    line = spark.createDataFrame([("a", START + timedelta(days=d), 2.0 * d) for d in range(10)], SCHEMA)
    made = baseline.forecast_baseline(line, "ds", "v", 2, "linear", "D", ["k"]).orderBy("step").collect()
    assert [r["prediction"] for r in made] == pytest.approx([20.0, 22.0])
    one = baseline.forecast_baseline(line.limit(1), "ds", "v", 1, "linear", "D").first()
    assert one["prediction"] is not None
    empty = baseline.forecast_baseline(line.where("false"), "ds", "v", 3)
    assert empty.count() == 0


def test_seasonal_beats_naive_and_equals_one_solve(spark, panel):
    long = panel.where("k <> 'tiny'")
    rows = seasonal.holdout_seasonal(long, "ds", "v", "D", ["k"], strategy="keyed")
    naive = evaluate.holdout_predictions(long, "ds", "v", ["k"], ["naive"], strategy="keyed").drop("total")
    board = evaluate.leaderboard(evaluate.holdout_metrics(rows.unionByName(naive), keys=["k", "model"]), ["k"])
    assert {r["model"] for r in board.where("rank = 1").collect()} == {"seasonal"}
    assert all(r["improvement_pct"] > 50 for r in board.where("rank = 1").collect())


def test_seasonal_slices_add_up(spark, panel, monkeypatch):
    whole = seasonal.fit_seasonal(panel.where("k = 'a'"), "ds", "v", strategy="keyed").first()["beta"]
    monkeypatch.setattr(seasonal, "ROWS_PER_SLICE", 23)
    sliced = seasonal.fit_seasonal(panel.where("k = 'a'"), "ds", "v", strategy="keyed").first()["beta"]
    assert sliced == pytest.approx(whole, abs=1e-6)


def test_seasonal_holidays(spark):
    rows = [("a", START + timedelta(days=d), 10.0 + (25.0 if d % 30 == 0 else 0.0)) for d in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    days = spark.createDataFrame([((START + timedelta(days=d)).date(),) for d in range(0, 330, 30)], "date date")
    made = seasonal.forecast_seasonal(df, "ds", "v", 5, "D", ["k"], holidays=days, strategy="keyed").orderBy("step").collect()
    assert made[0]["prediction"] > 30 and made[1]["prediction"] < 13


def config(**changes):
    return BoostedConfig("ds", "v", 7, "D", ("k",), lags=(1, 7, 14), rolling_windows=(7,), params={"maxIter": 8}, **changes)


def test_boosted_learns_the_week_and_survives_saving(spark, panel, tmp_path):
    model = fit_boosted(panel, config(), "keyed")
    made = model.predict(panel, strategy="keyed").orderBy("k", "step").collect()
    assert len(made) == 21
    truth = [100 + 10 * math.sin(2 * math.pi * (200 + i) / 7) for i in range(7)]
    got = [r["prediction"] for r in made if r["k"] == "a"]
    assert np.abs(np.array(got) - truth).mean() < 3
    model.save(str(tmp_path / "m"))
    again = BoostedModel.load(spark, str(tmp_path / "m"))
    assert again.config == model.config
    assert [r["prediction"] for r in again.predict(panel, strategy="keyed").orderBy("k", "step").collect()] == pytest.approx([r["prediction"] for r in made])


def test_boosted_holdout_uses_only_the_past(spark, panel):
    long = panel.where("k <> 'tiny'")
    rows = holdout_boosted(long, config(), strategy="keyed")
    assert rows.groupBy("k").count().collect()[0]["count"] == 40  # every row past the split
    first = rows.groupBy("k").agg(F.min("ds").alias("d")).collect()
    assert {r["d"] for r in first} == {START + timedelta(days=160)}
    shifted = long.withColumn("v", F.when(F.col("ds") >= START + timedelta(days=160), F.col("v") + 1000).otherwise(F.col("v")))
    other = holdout_boosted(shifted, config(), strategy="keyed")
    a = [r["predicted"] for r in rows.orderBy("k", "ds").collect()]
    b = [r["predicted"] for r in other.orderBy("k", "ds").collect()]
    assert a == pytest.approx(b)


def test_rounds_curve_is_the_error_of_each_prefix(spark, panel):
    long, c = panel.where("k <> 'tiny'"), config()
    held = holdout_tables(long, c, strategy="keyed")
    sides = feature_vectors(held.training, c), feature_vectors(held.test, c)
    curve = rounds_curve(*sides, {"maxIter": 6}, first_rounds=6)
    assert len(curve) == 6
    for rounds in (2, 6):
        made = holdout_boosted(long, replace(c, params={"maxIter": rounds}), strategy="keyed", tables=held)
        assert curve[rounds - 1] == pytest.approx(evaluate.holdout_metrics(made).first()["rmse"])
    # Doubling ends with the same curve, or with a best round that as many rounds again did not beat.
    grown = rounds_curve(*sides, {"maxIter": 6}, first_rounds=1)
    assert grown == pytest.approx(curve[: len(grown)])
    assert len(grown) == 6 or 2 * (grown.index(min(grown)) + 1) <= len(grown)


def test_tuning_takes_the_least_error_and_its_rounds(spark, panel):
    long, grid = panel.where("k <> 'tiny'"), ({"maxIter": 30, "stepSize": 0.3}, {"maxIter": 3, "stepSize": 0.01})
    tried = tried_settings(long, config(), grid, strategy="keyed", first_rounds=4)
    assert all(t.rmse == min(t.curve) and t.curve[t.params["maxIter"] - 1] == t.rmse for t in tried)
    assert len(tried[1].curve) == 3 and tried[1].rounds == 3  # slow steps want all rounds they may have
    params, error = tune_boosted(long, config(), grid, strategy="keyed", first_rounds=4)
    assert error <= min(t.rmse for t in tried)
    if error == tried[0].rmse:
        assert params == tried[0].params
    with pytest.raises(ValueError):
        tune_boosted(panel.where("k = 'tiny'").limit(0), config(), grid, strategy="keyed")


@pytest.mark.parametrize("kind", KINDS)
def test_any_model_predicts_again_from_its_files(spark, panel, tmp_path, kind):
    settings = ModelSettings(kind, "ds", "v", 7, "D", ("k",), gap=2, strategy="keyed")
    model = fit_model(panel, settings, config(gap=2) if kind == "boosted" else None)
    made = model.predict().orderBy("k", "step").collect()
    assert len(made) == 21 and {r["model_name"] for r in made} == {kind}
    model.save(str(tmp_path / "m"))
    again = StoredModel.load(spark, str(tmp_path / "m"))
    assert again.settings == settings
    assert [tuple(r)[:3] for r in again.predict().orderBy("k", "step").collect()] == [tuple(r)[:3] for r in made]
    close = [r["prediction"] for r in again.predict().orderBy("k", "step").collect()]
    assert close == pytest.approx([r["prediction"] for r in made])
    assert again.predict(3).count() == 9
    # The same rows leave it where it is; a later row moves the forecasts on by its days.
    assert [r["ds"] for r in again.moved_to(panel).predict().orderBy("k", "step").collect()] == [r["ds"] for r in made]
    last = panel.where("k = 'a'").agg(F.max("ds")).first()[0]
    newer = panel.unionByName(spark.createDataFrame([("a", last + timedelta(days=1), 100.0)], panel.schema))
    first = again.moved_to(newer).predict().where("k = 'a' AND step = 1").first()
    assert first["ds"] == last + timedelta(days=4) and first["prediction"] is not None
    with pytest.raises(ValueError):
        replace(settings, kind="other")


def test_moved_seasonal_model_is_saved_with_its_place(spark, panel, tmp_path):
    model = fit_model(panel, ModelSettings("seasonal", "ds", "v", 3, "D", ("k",), strategy="keyed"))
    cut = panel.where(F.col("ds") < START + timedelta(days=10))
    model.moved_to(cut).save(str(tmp_path / "m"))
    again = StoredModel.load(spark, str(tmp_path / "m")).predict()
    assert again.agg(F.max("ds")).first()[0] <= START + timedelta(days=12)


def test_boosted_exogenous_values(spark):
    rng = random.Random(5)
    rows = []
    for d in range(150):
        promo = float(rng.random() < 0.3)
        rows.append(("a", START + timedelta(days=d), 10 + 30 * promo, promo))
    df = spark.createDataFrame(rows, SCHEMA + ", promo double")
    model = fit_boosted(df, config(exog=("promo",)), "keyed")
    future = spark.createDataFrame([("a", START + timedelta(days=150 + i), float(i % 2)) for i in range(7)], "k string, ds timestamp_ntz, promo double")
    made = [r["prediction"] for r in model.predict(df, future_exog=future, strategy="keyed").orderBy("step").collect()]
    assert all(p > 30 for p in made[1::2]) and all(p < 20 for p in made[0::2])
    with pytest.raises(ValueError):
        model.predict(df)


def test_health_of_perfect_and_bad_forecasts(spark):
    rng = random.Random(9)
    rows = [("good", i, 50.0 + i % 5, 50.0 + i % 5 + rng.gauss(0, 0.1), 20.0) for i in range(40)]
    rows += [("bad", i, float(i), 100.0, 20.0) for i in range(20)]
    pairs = spark.createDataFrame(rows, "k string, i int, actual double, predicted double, naive double")
    quality = spark.createDataFrame([("good", 200, 0.0, 0.0, 2), ("bad", 40, 30.0, 8.0, None)], "k string, total_rows bigint, missing_pct double, outliers_pct double, data_age_days int")
    made = {r["k"]: r for r in health.diagnose(pairs, quality, None, "i", ["k"], strategy="keyed").collect()}
    assert made["good"]["health_band"] == "EXCELLENT" and made["good"]["warnings"] == []
    codes = {w["code"] for w in made["bad"]["warnings"]}
    assert codes == {"not_beating_naive", "autocorrelated", "trending_residuals", "missing_data", "outliers", "few_rows"}
    assert made["bad"]["quality_points"] == 2.0 and made["bad"]["health_band"] == "POOR"


def test_sanity_of_constant_history(spark):
    past = spark.createDataFrame([("a", START + timedelta(days=d), 5.0) for d in range(5)], SCHEMA)
    ahead = spark.createDataFrame([("a", 1, 5.5), ("a", 2, -1.0)], "k string, step int, prediction double")
    row = health.forecast_sanity(ahead, past, "ds", "v", ["k"], metric_name="sales").first()
    assert [w["code"] for w in row["sanity_warnings"]] == ["negative_forecast", "above_history", "below_history"]


def test_constant_residuals_are_not_random(spark):
    pairs = spark.createDataFrame([(i, 2.0, 1.0) for i in range(12)], "i int, actual double, predicted double")
    row = health.residual_analysis(pairs, "i").first()
    assert row["autocorr_lag1"] is None and not row["is_random"] and not row["has_trend"]


def test_model_rules(spark):
    df = spark.createDataFrame([(50, False, False, False), (150, True, True, True), (150, True, False, True), (300, True, False, False), (150, True, False, False)], "n int, s boolean, h boolean, g boolean")
    got = [r[0] for r in df.select(evaluate.select_model(*[F.col(c) for c in "nshg"])).collect()]
    assert got == ["simple_ewm", "seasonal", "boosted_global", "seasonal", "boosted"]
    ranked = evaluate.recommend_model(spark.createDataFrame([(50, 1, 0.0)], "n_rows int, n_groups int, outliers_pct double"))
    assert ranked.orderBy("rank").first()["model"] == "linear"


def test_leaderboard_puts_unusable_errors_last(spark):
    metrics = spark.createDataFrame([("naive", 10.0), ("linear", 5.0), ("boosted", float("inf")), ("seasonal", float("nan"))], "model string, rmse double")
    board = {r["model"]: (r["rank"], r["improvement_pct"]) for r in evaluate.leaderboard(metrics).collect()}
    assert board["linear"] == (1, 50.0) and board["boosted"][0] > 2 and board["seasonal"][0] > 2
    assert evaluate.best_model(metrics).first()["best_model"] == "linear"


def as_of():
    return F.lit("2023-07-25 00:00:00").cast("timestamp_ntz")


def test_workflow_on_a_panel(spark, panel):
    job = Job("ds", "v", 7, None, ("k",), params={"maxIter": 4, "maxDepth": 3}, strategy="keyed")
    result = run_workflow(panel.where("k <> 'tiny'"), job, as_of())
    assert result.success and result.analysis["frequency"] == "D"
    assert [s.name for s in result.steps] == ["analysis", "preparation", "features", "training", "evaluation", "forecast"]
    assert {r["model"] for r in result.metrics.collect()} == {"naive", "boosted"}
    assert result.best_model == "boosted" and result.forecast.count() == 14
    assert {r["k"] for r in result.diagnostics.collect()} == {"a", "b"}


def test_workflow_prepares_dirty_data(spark):
    rows = [(d, (None if i % 13 == 4 else v)) for i, (_, d, v) in enumerate(weekly(120)) if i % 6 != 5]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "ds timestamp_ntz, sales double")
    result = run_workflow(df, Job("ds", "sales", 5, "D", model="linear"), as_of())
    assert {s.id for s in result.preparation} >= {"fill_missing", "handle_duplicates", "fix_frequency"}
    assert result.prepared.where("sales is null").count() == 0
    assert result.prepared.count() == 119 and result.forecast.count() == 5
    with pytest.raises(ValueError):
        run_workflow(df.limit(5), Job("ds", "sales", 5, "D"), as_of())


def test_forecast_chooses_by_length(spark, panel):
    made, diagnosed = forecast(panel.where("k = 'tiny'"), Job("ds", "v", 3, "D", ("k",)), as_of())
    assert made.first()["model_name"] == "naive" and made.count() == 3 and diagnosed.count() == 0


def test_wizard_on_tiny_tables(spark):
    for n in (0, 1, 2):
        df = spark.createDataFrame(weekly(n), SCHEMA)
        row = prf.wizard_analysis(df, "ds", "v", as_of()).first()
        assert row["n_rows"] == n and "small_dataset" in [i["id"] for i in row["issues"]]
        assert prf.suggest_preparations(row.asDict(recursive=True))[0].id == "no_prep_needed"


def test_datetime_detection_needs_every_sample_to_parse(spark):
    df = spark.createDataFrame([("x1", "2024-01-01", 1.0), ("2024-01-02", "2024-01-02", 2.0)], "update_time string, day string, v double")
    assert prf.detect_datetime(df) == "day"
    assert prf.detect_target(df) == "v"
    assert prf.detect_datetime(df.select("v")) is None


def test_payload_round_trip(spark, panel):
    made = baseline.forecast_baseline(panel, "ds", "v", 3, "naive", "D", ["k"], strategy="keyed")
    back = sinks.read_payload(sinks.forecast_payload(made, ["k"]), keep=["k"])
    assert sorted(back.select("k", "step", "ds", "prediction").collect()) == sorted(made.select("k", "step", "ds", "prediction").collect())
