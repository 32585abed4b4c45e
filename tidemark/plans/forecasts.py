"""Queries: models, evaluation, diagnostics and the flagship forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.diagnostics import health
from tidemark.models import baseline, evaluate
from tidemark.models.boosted import BoostedConfig, fit_boosted, tried_settings
from tidemark.models.seasonal import SeasonalConfig, design, fit_seasonal, forecast_seasonal, holdout_seasonal
from tidemark.models.stored import ModelSettings, StoredModel, fit_model
from tidemark.operators.aggregate import resample
from tidemark.operators.features import create_features
from tidemark.operators.profile import data_quality
from tidemark.plans.registry import ORDER_PANEL, PANEL, order_panel, panel, query, rounded, table
from tidemark.plans.workflow import Job, forecast, holdout_of, predict_existing, run_workflow
from tidemark.session import fresh_path
from tidemark.sources import sinks

SPLIT = """x AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series) AS total FROM order_panel),
fit AS (
  SELECT series, arg_max(value, i) AS last_value, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept, count(*) AS n_train
  FROM x WHERE i < floor(total * 0.8::DOUBLE) GROUP BY 1),
test AS (
  SELECT x.series, x.ds, x.i, x.value AS actual, f.last_value AS naive, f.intercept + f.slope * x.i AS linear
  FROM x JOIN fit f USING (series) WHERE x.i >= floor(x.total * 0.8::DOUBLE)),
long AS (
  SELECT series, ds, actual, 'naive' AS model, naive AS predicted FROM test UNION ALL SELECT series, ds, actual, 'linear', linear FROM test)"""

ERRORS = """sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
  avg(abs(actual - predicted) / (abs(actual) + 1e-10)) * 100 AS mape"""


def _as_of():
    return F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")


FLAGSHIP = f"""WITH {PANEL},
f AS (SELECT event_type, ds, value, lag(value, 1) OVER w AS lag_1, avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mean_7,
        row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS total
      FROM panel WINDOW w AS (PARTITION BY event_type ORDER BY ds)),
fit AS (SELECT event_type, arg_max(value, i) AS naive, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept
        FROM f WHERE i < floor(total * 0.8::DOUBLE) GROUP BY 1),
t AS (SELECT f.*, naive, intercept + slope * i AS linear FROM f JOIN fit USING (event_type) WHERE i >= floor(total * 0.8::DOUBLE)),
long AS (SELECT event_type, 'naive' AS model, value AS actual, naive AS predicted, lag_1, rolling_mean_7 FROM t UNION ALL
         SELECT event_type, 'linear', value, linear, lag_1, rolling_mean_7 FROM t)
SELECT event_type, model, count(*) AS n, round(sqrt(avg((actual - predicted) ** 2)), 4) AS rmse, round(avg(abs(actual - predicted)), 4) AS mae,
       round(avg(abs(actual - predicted) / (abs(actual) + 1e-10)) * 100, 4) AS mape,
       round(avg(abs(actual - lag_1)), 4) AS mae_lag_1, round(avg(abs(actual - rolling_mean_7)), 4) AS mae_rolling
FROM long GROUP BY 1, 2"""


@query("flagship_daily_forecast", FLAGSHIP)
def _(spark, sf):
    days = resample(table(spark, sf, "events"), "ts", "D", "sum", "value", ["event_type"]).withColumnRenamed("ts", "ds")
    featured = create_features(days, "ds", "value", [1], [7], False, False, ["event_type"], strategy="keyed")
    tested = evaluate.holdout_predictions(
        featured, "ds", "value", ["event_type"], ("naive", "linear"), min_rows=1, strategy="keyed"
    )
    with_features = tested.join(featured.drop("value"), ["event_type", "ds"])
    a, p = F.col("actual"), F.col("predicted")
    made = with_features.groupBy("event_type", "model").agg(
        F.count(F.lit(1)).alias("n"), evaluate.rmse(a, p).alias("rmse"), evaluate.mae(a, p).alias("mae"),
        evaluate.mape(a, p).alias("mape"), evaluate.mae(a, F.col("lag_1")).alias("mae_lag_1"),
        evaluate.mae(a, F.col("rolling_mean_7")).alias("mae_rolling"),
    )
    return made.select("event_type", "model", "n", *[rounded(c) for c in ("rmse", "mae", "mape", "mae_lag_1", "mae_rolling")])


# -- closed-form models -------------------------------------------------------------------------


@query("mdl_01_naive", f"""WITH {PANEL}, l AS (SELECT event_type, max(ds) AS last, arg_max(value, ds) AS value FROM panel GROUP BY 1)
SELECT event_type, CAST(h AS INTEGER) AS step, last + to_days(CAST(h AS INTEGER)) AS ds, round(value, 4) AS prediction FROM l, range(1, 15) r(h)""")
def _(spark, sf):
    made = baseline.forecast_baseline(panel(spark, sf), "ds", "value", 14, "naive", "D", ["event_type"], strategy="keyed")
    return made.select("event_type", "step", "ds", rounded("prediction"))


@query("mdl_01_naive_raw_rows", """
WITH l AS (SELECT event_type, max(ts) AS last, arg_max(value, ts) AS value FROM events GROUP BY 1)
SELECT event_type, CAST(h AS INTEGER) AS step, last + to_seconds(181 * (h + 2)) AS ds, round(value, 4) AS prediction FROM l, range(1, 6) r(h)""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    made = baseline.forecast_baseline(
        events, "ts", "value", 5, "naive", "181s", ["event_type"], 2, ["event_id"], strategy="banded"
    )
    return made.select("event_type", "step", "ds", rounded("prediction"))


@query("mdl_02_linear", f"""WITH {ORDER_PANEL},
x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i FROM order_panel),
f AS (SELECT series, max(ds) AS last, count(*) AS n, regr_slope(value, i) AS s, regr_intercept(value, i) AS b FROM x GROUP BY 1)
SELECT series, CAST(h AS INTEGER) AS step, last + to_days(CAST(h + 3 AS INTEGER)) AS ds, round(b + s * (n + 3 + h - 1), 3) AS prediction FROM f, range(1, 15) r(h)""")
def _(spark, sf):
    made = baseline.forecast_baseline(
        order_panel(spark, sf), "ds", "value", 14, "linear", "D", ["series"], gap=3, strategy="keyed"
    )
    return made.select("series", "step", "ds", rounded("prediction", 3))


@query("mdl_05_simple_ewm", f"""WITH {PANEL},
x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM panel)
SELECT event_type, CAST(h AS INTEGER) AS step, max(ds) + to_days(CAST(h AS INTEGER)) AS ds,
       round(sum(value * (CASE WHEN i = 0 THEN 1 ELSE 2::DOUBLE / 16 END) * power(14::DOUBLE / 16, n - 1 - i)), 4) AS prediction
FROM x, range(1, 8) r(h) GROUP BY event_type, h""")
def _(spark, sf):
    made = baseline.forecast_baseline(
        panel(spark, sf), "ds", "value", 7, "simple_ewm", "D", ["event_type"], span=15, strategy="keyed"
    )
    return made.select("event_type", "step", "ds", rounded("prediction"))


@query("mdl_06_evaluate_models", f"""WITH order_panel AS (
  SELECT 'all' AS series, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ds, sum(o_totalprice) AS value FROM orders GROUP BY 2),
{SPLIT}
SELECT model, count(*) AS n, round(sqrt(avg((actual - predicted) ** 2)), 3) AS rmse, round(avg(abs(actual - predicted)), 3) AS mae,
       round(avg(abs(actual - predicted) / (abs(actual) + 1e-10)) * 100, 3) AS mape FROM long GROUP BY 1""")
def _(spark, sf):
    made = evaluate.evaluate_models(order_panel(spark, sf), "ds", "value", ["series"], strategy="keyed")
    return made.select("model", "n", *[rounded(c, 3) for c in ("rmse", "mae", "mape")])


@query("mdl_07_holdout_metrics", f"""WITH {ORDER_PANEL}, {SPLIT}, m AS (SELECT series, model, count(*) AS n, {ERRORS} FROM long GROUP BY 1, 2)
SELECT series, model, n, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(mape, 3) AS mape FROM m""")
def _(spark, sf):
    rows = evaluate.holdout_predictions(order_panel(spark, sf), "ds", "value", ["series"], strategy="keyed")
    made = evaluate.holdout_metrics(rows, keys=["series", "model"])
    return made.select("series", "model", "n", *[rounded(c, 3) for c in ("rmse", "mae", "mape")])


@query("srt_05_leaderboard", f"""WITH {ORDER_PANEL}, {SPLIT}, m AS (SELECT series, model, {ERRORS} FROM long GROUP BY 1, 2)
SELECT series, model, round(rmse, 3) AS rmse, CAST(row_number() OVER (PARTITION BY series ORDER BY rmse, model) AS INTEGER) AS rank,
       round((1 - rmse / max(CASE WHEN model = 'naive' THEN rmse END) OVER (PARTITION BY series)) * 100, 4) AS improvement_pct FROM m""")
def _(spark, sf):
    rows = evaluate.holdout_predictions(order_panel(spark, sf), "ds", "value", ["series"], strategy="keyed")
    board = evaluate.leaderboard(evaluate.holdout_metrics(rows, keys=["series", "model"]), ["series"])
    return board.select("series", "model", rounded("rmse", 3), "rank", rounded("improvement_pct"))


@query("mdl_06_best_model", f"""WITH {ORDER_PANEL}, {SPLIT}, m AS (SELECT series, model, {ERRORS} FROM long GROUP BY 1, 2)
SELECT series, arg_min(model, rmse) AS best_model, round(min(rmse), 3) AS best_rmse FROM m GROUP BY 1""")
def _(spark, sf):
    rows = evaluate.holdout_predictions(order_panel(spark, sf), "ds", "value", ["series"], strategy="keyed")
    best = evaluate.best_model(evaluate.holdout_metrics(rows, keys=["series", "model"]), ["series"])
    return best.select("series", "best_model", rounded("best_rmse", 3))


@query("mdl_09_select_model", """
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n * 10 < 100 THEN 'simple_ewm' WHEN o_custkey % 2 = 0 AND o_custkey % 5 = 0 THEN 'seasonal'
  WHEN o_custkey % 3 = 0 THEN 'boosted_global' WHEN o_custkey % 2 = 0 AND n * 10 >= 200 THEN 'seasonal' ELSE 'boosted' END AS model,
  CASE WHEN n * 10 >= 100 THEN 'boosted' WHEN n * 10 < 30 THEN 'naive' ELSE 'linear' END AS quick FROM c""")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 10).alias("n"))
    k, n = F.col("o_custkey"), F.col("n")
    chosen = evaluate.select_model(n, k % 2 == 0, k % 5 == 0, k % 3 == 0)
    return counts.select("o_custkey", chosen.alias("model"), evaluate.auto_model(n).alias("quick"))


@query("mdl_11_auto_model", """
SELECT o_orderstatus, CASE WHEN count(*) >= 100 THEN 'boosted' WHEN count(*) < 30 THEN 'naive' ELSE 'linear' END AS model FROM orders GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(evaluate.auto_model(F.count(F.lit(1))).alias("model"))


@query("mdl_10_recommend_model", """
WITH c AS (SELECT o_custkey, count(*) * 8 AS n_rows, count(DISTINCT o_orderpriority) AS n_groups, (o_custkey % 5)::DOUBLE AS outliers_pct FROM orders GROUP BY 1),
s AS (SELECT *, 'boosted' AS model, 0 AS p, (CASE WHEN n_rows >= 100 THEN 3 ELSE 0 END) + (CASE WHEN n_groups > 1 THEN 2 ELSE 0 END) + (CASE WHEN outliers_pct > 2 THEN 1 ELSE 0 END) + 2 AS score FROM c
  UNION ALL SELECT *, 'linear', 1, (CASE WHEN n_rows < 100 THEN 3 ELSE 0 END) + (CASE WHEN outliers_pct < 2 THEN 1 ELSE 0 END) + 1 FROM c
  UNION ALL SELECT *, 'seasonal', 2, 2 + (CASE WHEN n_groups <= 1 THEN 1 ELSE 0 END) + 1 FROM c
  UNION ALL SELECT *, 'naive', 3, 0 FROM c)
SELECT o_custkey, model, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, p) AS INTEGER) AS rank FROM s""")
def _(spark, sf):
    analyses = table(spark, sf, "orders").groupBy("o_custkey").agg(
        (F.count(F.lit(1)) * 8).alias("n_rows"), F.count_distinct("o_orderpriority").alias("n_groups"),
        (F.first("o_custkey") % 5).cast("double").alias("outliers_pct"),
    )
    return evaluate.recommend_model(analyses, frequency="D").select("o_custkey", "model", "score", "rank")


# -- diagnostics ----------------------------------------------------------------------------------


def _pairs(spark, sf):
    rows = evaluate.holdout_predictions(order_panel(spark, sf), "ds", "value", ["series"], strategy="keyed")
    return rows.groupBy("series", "ds").agg(
        F.max("actual").alias("actual"),
        F.max(F.when(F.col("model") == "linear", F.col("predicted"))).alias("predicted"),
        F.max(F.when(F.col("model") == "naive", F.col("predicted"))).alias("naive"),
    )


RESIDUALS = """res AS (
  SELECT series, ds, actual - linear AS r, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS j,
         lag(actual - linear) OVER (PARTITION BY series ORDER BY ds) AS before FROM test),
ra AS (
  SELECT series, count(*) AS n, avg(r) AS mean_residual, stddev_pop(r) AS std_residual, corr(r, before) AS ac,
         count(*) >= 10 AND abs(regr_slope(r, j)) > 0.1 * stddev_pop(r) AS has_trend FROM res GROUP BY 1)"""

BASE = """bm AS (
  SELECT series, avg(abs(actual - linear)) AS mae_model, sqrt(avg((actual - linear) ** 2)) AS rmse_model,
         avg(abs(actual - linear) / (abs(actual) + 1e-10)) * 100 AS mape_model, avg(abs(actual - naive)) AS mae_naive,
         sqrt(avg((actual - naive) ** 2)) AS rmse_naive, avg(abs(actual - naive) / (abs(actual) + 1e-10)) * 100 AS mape_naive FROM test GROUP BY 1)"""


@query("dia_01_residuals", f"""WITH {ORDER_PANEL}, {SPLIT}, {RESIDUALS}
SELECT series, n, round(mean_residual, 3) AS mean_residual, round(std_residual, 3) AS std_residual, round(ac, 6) AS autocorr_lag1, has_trend,
       abs(ac) < 0.2 AND NOT has_trend AS is_random FROM ra""")
def _(spark, sf):
    made = health.residual_analysis(_pairs(spark, sf), "ds", ["series"], strategy="keyed")
    return made.select(
        "series", "n", rounded("mean_residual", 3), rounded("std_residual", 3), rounded("autocorr_lag1", 6), "has_trend", "is_random"
    )


@query("dia_01_residual_rows", f"""WITH {ORDER_PANEL}, {SPLIT} SELECT series, ds, round(actual - linear, 3) AS residual FROM test""")
def _(spark, sf):
    return health.residuals(_pairs(spark, sf)).select("series", "ds", rounded("residual", 3))


@query("dia_02_baseline_metrics", f"""WITH {ORDER_PANEL}, {SPLIT}, {BASE}
SELECT series, round(mae_model, 3) AS mae_model, round(rmse_model, 3) AS rmse_model, round(mape_model, 3) AS mape_model, round(mae_naive, 3) AS mae_naive,
       round(rmse_naive, 3) AS rmse_naive, round(mape_naive, 3) AS mape_naive, round((rmse_naive - rmse_model) / rmse_naive * 100, 4) AS rmse_improvement_pct,
       round((mape_naive - mape_model) / mape_naive * 100, 4) AS mape_improvement_pct, rmse_naive > rmse_model AS beats_baseline FROM bm""")
def _(spark, sf):
    made = health.baseline_metrics(_pairs(spark, sf), ["series"])
    errors = [rounded(f"{e}_{m}", 3) for m in ("model", "naive") for e in ("mae", "rmse", "mape")]
    return made.select("series", *errors, rounded("rmse_improvement_pct"), rounded("mape_improvement_pct"), "beats_baseline")


# The forecast checked below is the linear one, moved far off so that every rule fires somewhere.
MOVED = """ahead AS (
  SELECT series, j + 1 AS step, linear * (CASE WHEN series LIKE '1%' THEN 30 WHEN series LIKE '2%' THEN -1 ELSE 1 END) AS prediction
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS j FROM test)),
h AS (SELECT series, min(value) AS lo, max(value) AS hi, arg_max(value, ds) AS last FROM order_panel GROUP BY 1),
sa AS (SELECT series, min(prediction) AS pmin, max(prediction) AS pmax, arg_min(prediction, step) AS p1, count(*) FILTER (WHERE prediction < 0) AS neg FROM ahead GROUP BY 1),
sn AS (SELECT series, pmin, pmax, neg, (p1 - last) / nullif(abs(last), 0) * 100 AS change,
         concat_ws(',', CASE WHEN neg > 0 THEN 'negative_forecast' END, CASE WHEN pmax > hi + 0.5 * (hi - lo) THEN 'above_history' END,
           CASE WHEN pmin < lo - 0.5 * (hi - lo) THEN 'below_history' END, CASE WHEN abs((p1 - last) / nullif(abs(last), 0) * 100) > 50 THEN 'jump' END) AS notes
       FROM sa JOIN h USING (series))"""


def _moved(spark, sf):
    rows = _pairs(spark, sf).withColumn("step", F.col("ds"))
    factor = F.when(F.col("series").startswith("1"), 30).when(F.col("series").startswith("2"), -1).otherwise(1)
    return rows.select("series", "step", (F.col("predicted") * factor).alias("prediction"))


def _codes(column):
    return F.concat_ws(",", F.transform(column, lambda n: n["code"])).alias(column)


@query("dia_03_forecast_sanity", f"""WITH {ORDER_PANEL}, {SPLIT}, {MOVED}
SELECT series, round(pmin, 3) AS pred_min, round(pmax, 3) AS pred_max, neg AS n_negative, round(change, 4) AS first_change_pct,
       notes AS sanity_warnings FROM sn""")
def _(spark, sf):
    made = health.forecast_sanity(
        _moved(spark, sf), order_panel(spark, sf), "ds", "value", ["series"], metric_name="daily_sales"
    )
    return made.select(
        "series", rounded("pred_min", 3), rounded("pred_max", 3), "n_negative", rounded("first_change_pct"), _codes("sanity_warnings")
    )


HEALTH = f"""WITH {ORDER_PANEL}, {SPLIT}, {RESIDUALS}, {BASE}, {MOVED},
mz AS (SELECT series, avg(value) AS m, stddev_samp(value) AS sd FROM order_panel GROUP BY 1),
q AS (SELECT series, count(*) AS total_rows, 0.0::DOUBLE AS missing_pct, 100.0 * count(*) FILTER (WHERE abs(value - m) / sd > 3) / count(*) AS outliers_pct,
        CAST(floor(epoch(TIMESTAMP '2001-08-10 00:00:00' - max(ds)) / 86400) AS INTEGER) AS age FROM order_panel JOIN mz USING (series) GROUP BY 1),
a AS (SELECT *, rmse_naive > rmse_model AS beats, (rmse_naive - rmse_model) / rmse_naive * 100 AS imp, abs(ac) < 0.2 AND NOT has_trend AS rnd
      FROM ra JOIN bm USING (series) JOIN q USING (series) JOIN sn USING (series)),
w AS (SELECT *, concat_ws(',', CASE WHEN NOT beats THEN 'not_beating_naive' END, CASE WHEN NOT rnd AND abs(ac) > 0.4 THEN 'autocorrelated' END,
        CASE WHEN NOT rnd AND has_trend THEN 'trending_residuals' END, CASE WHEN missing_pct > 10 THEN 'missing_data' END, CASE WHEN outliers_pct > 5 THEN 'outliers' END,
        CASE WHEN age > 30 THEN 'stale_data' END, CASE WHEN age > 7 AND age <= 30 THEN 'aging_data' END, CASE WHEN total_rows < 50 THEN 'few_rows' END, nullif(notes, '')) AS warned,
      concat_ws(',', CASE WHEN beats THEN 'beats_naive' END, CASE WHEN rnd THEN 'random_residuals' END, CASE WHEN missing_pct < 5 THEN 'complete_data' END,
        CASE WHEN age < 7 THEN 'fresh_data' END, CASE WHEN notes = '' THEN 'sane_forecast' END) AS trusted FROM a),
p AS (SELECT *, CASE WHEN rnd THEN 25.0 WHEN abs(ac) < 0.4 THEN 15.0 ELSE 5.0 END::DOUBLE AS residual_points,
        CASE WHEN beats THEN least(25.0, 10.0 + imp / 2) ELSE 0.0 END::DOUBLE AS baseline_points,
        ((CASE WHEN missing_pct < 5 THEN 10 WHEN missing_pct < 15 THEN 5 ELSE 0 END) + (CASE WHEN outliers_pct < 5 THEN 5 WHEN outliers_pct < 10 THEN 2 ELSE 0 END)
          + (CASE WHEN age < 7 THEN 10 WHEN age < 30 THEN 5 ELSE 0 END))::DOUBLE AS quality_points, greatest(0.0, 25.0 - 5.0 * n_warned)::DOUBLE AS warning_points
      FROM (SELECT *, CASE WHEN warned = '' THEN 0 ELSE len(string_split(warned, ',')) END AS n_warned FROM w)),
s AS (SELECT *, residual_points + baseline_points + quality_points + warning_points AS score FROM p)"""


def _diagnosed(spark, sf):
    days = order_panel(spark, sf)
    as_of = F.lit("2001-08-10 00:00:00").cast("timestamp_ntz")
    quality = data_quality(days, "ds", "value", as_of, ["series"])
    sanity = health.forecast_sanity(_moved(spark, sf), days, "ds", "value", ["series"], metric_name="daily_sales")
    return health.diagnose(_pairs(spark, sf), quality, sanity, "ds", ["series"], strategy="keyed")


@query("dia_04_trust_indicators", f"{HEALTH} SELECT series, trusted AS trust FROM s")
def _(spark, sf):
    return _diagnosed(spark, sf).select("series", _codes("trust"))


POINTS = ("residual_points", "baseline_points", "quality_points", "warning_points")


@query("dia_05_health_score", f"""{HEALTH} SELECT series, {", ".join(f"round({p}, 4) AS {p}" for p in POINTS)}, round(score, 4) AS health_score,
  CASE WHEN score >= 85 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 50 THEN 'FAIR' ELSE 'POOR' END AS health_band FROM s""")
def _(spark, sf):
    made = _diagnosed(spark, sf)
    return made.select("series", *[rounded(p) for p in POINTS], rounded("health_score"), "health_band")


@query("dia_06_warnings", f"{HEALTH} SELECT series, warned AS warnings FROM s")
def _(spark, sf):
    return _diagnosed(spark, sf).select("series", _codes("warnings"))


@query("dia_07_per_series", f"""{HEALTH} SELECT series, n, round(ac, 6) AS autocorr_lag1, has_trend, rnd AS is_random, round(rmse_model, 3) AS rmse_model,
  round(imp, 4) AS rmse_improvement_pct, n_warned::INTEGER AS n_warnings, round(score, 4) AS health_score FROM s""")
def _(spark, sf):
    made = _diagnosed(spark, sf)
    return made.select(
        "series", "n", rounded("autocorr_lag1", 6), "has_trend", "is_random", rounded("rmse_model", 3),
        rounded("rmse_improvement_pct"), F.size("warnings").alias("n_warnings"), rounded("health_score"),
    )


# -- learned models and whole runs (rows only) ------------------------------------------------------


def _boosted_config(**changes):
    return BoostedConfig(
        "ds", "value", 7, "D", ("series",), lags=(1, 2, 7, 14), rolling_windows=(7, 28), **changes
    )


@query("mdl_03_boosted")
def _(spark, sf):
    days = order_panel(spark, sf)
    return fit_boosted(days, _boosted_config(), "keyed").predict(days, strategy="keyed")


STEPS = f"""WITH {ORDER_PANEL}, l AS (SELECT series, max(ds) AS last FROM order_panel GROUP BY 1)
SELECT series, CAST(h AS INTEGER) AS step, last + to_days(CAST(h AS INTEGER)) AS ds, '{{model}}' AS model_name, true AS finite FROM l, range(1, {{steps}}) r(h)"""


def _steps(made):
    finite = F.coalesce(F.abs("prediction") < F.lit(float("inf")), F.lit(False))
    return made.select("series", "step", "ds", "model_name", finite.alias("finite"))


@query("mdl_03_boosted_steps", STEPS.format(model="boosted", steps=8))
def _(spark, sf):
    days = order_panel(spark, sf)
    return _steps(fit_boosted(days, _boosted_config(), "keyed").predict(days, strategy="keyed"))


@query("mdl_04_seasonal_steps", STEPS.format(model="seasonal", steps=31))
def _(spark, sf):
    return _steps(forecast_seasonal(order_panel(spark, sf), "ds", "value", 30, "D", ["series"], strategy="keyed"))


@query("mdl_04_seasonal_gradient", f"WITH {ORDER_PANEL} SELECT series, 0.0::DOUBLE AS steepest FROM order_panel GROUP BY 1")
def _(spark, sf):
    # The penalised squares have their minimum where the gradient of every coefficient is zero.
    days, c = order_panel(spark, sf), SeasonalConfig.for_frequency("D")
    fitted = fit_seasonal(days, "ds", "value", ["series"], c, strategy="keyed")
    rows = days.join(fitted, "series").withColumn("x", design(F.col("ds"), F.col("start"), F.col("end"), c))
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    slopes = rows.select("series", "beta", (dot - F.col("value") / F.col("scale")).alias("r"), F.posexplode("x").alias("i", "x"))
    summed = slopes.groupBy("series", "i").agg(F.sum(F.col("x") * F.col("r")).alias("g"), F.first(F.get("beta", F.col("i"))).alias("b"))
    penalty = F.get(F.lit(c.penalties()), F.col("i"))
    return summed.groupBy("series").agg(F.max(F.abs(F.col("g") + penalty * F.col("b"))).alias("m")).select("series", rounded("m", 5, "steepest"))


@query("mdl_04_seasonal")
def _(spark, sf):
    return forecast_seasonal(order_panel(spark, sf), "ds", "value", 30, "D", ["series"], strategy="keyed")


@query("mdl_04_seasonal_holdout")
def _(spark, sf):
    rows = holdout_seasonal(order_panel(spark, sf), "ds", "value", "D", ["series"], strategy="keyed")
    return evaluate.holdout_metrics(rows, keys=["series", "model"])


@query("mdl_08_tune")
def _(spark, sf):
    tried = tried_settings(order_panel(spark, sf), _boosted_config(), strategy="keyed")
    best = min(t.rmse for t in tried)
    rows = [(str(sorted(t.params.items())), len(t.curve), t.rmse, t.rmse == best) for t in tried]
    return spark.createDataFrame(rows, "params string, rounds_fitted int, rmse double, chosen boolean")


GRIDDED = f"""WITH {ORDER_PANEL},
s AS (SELECT series, min(ds) AS lo, max(ds) AS hi FROM order_panel GROUP BY 1),
g AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ds FROM s),
p AS (SELECT series, ds, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
      FROM g LEFT JOIN order_panel USING (series, ds)),
x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i FROM p),
f AS (SELECT series, max(ds) AS last, count(*) AS n, regr_slope(value, i) AS s, regr_intercept(value, i) AS b FROM x GROUP BY 1)"""


@query("mdl_12_forecast", f"""{GRIDDED}
SELECT series, CAST(h AS INTEGER) AS step, last + to_days(CAST(h AS INTEGER)) AS ds, round(b + s * (n + h - 1), 3) AS prediction, 'linear' AS model_name
FROM f, range(1, 15) r(h)""")
def _(spark, sf):
    job = Job("ds", "value", 14, "D", ("series",), model="linear", strategy="keyed")
    made, _ = forecast(order_panel(spark, sf), job, _as_of())
    return made.select("series", "step", "ds", rounded("prediction", 3), "model_name")


GAPPED = SPLIT.replace("WHERE x.i >= floor(x.total * 0.8::DOUBLE)", "WHERE x.i >= floor(x.total * 0.8::DOUBLE) + 5")


def _gapped(spark, sf, models):
    job = Job("ds", "value", 14, "D", ("series",), gap=5, strategy="keyed")
    return holdout_of(order_panel(spark, sf), job, models, "D", {"lags": (1, 7), "rolling_windows": (7,), "date_features": ("month",), "use_ewm": False})


@query("mdl_13_candidates", f"""WITH {ORDER_PANEL}, {GAPPED}
SELECT series, m.model, count(*) AS n, min(ds) AS first_ds, max(ds) AS last_ds FROM test, (VALUES ('naive'), ('linear'), ('seasonal'), ('boosted')) m(model) GROUP BY ALL""")
def _(spark, sf):
    rows = _gapped(spark, sf, ("naive", "linear", "seasonal", "boosted"))
    return rows.groupBy("series", "model").agg(F.count("predicted").alias("n"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


@query("mdl_13_leaderboard", f"""WITH {ORDER_PANEL}, {GAPPED}, m AS (SELECT model, count(*) AS n, {ERRORS} FROM long GROUP BY 1)
SELECT model, n, round(rmse, 3) AS rmse, CAST(row_number() OVER (ORDER BY rmse, model) AS INTEGER) AS rank FROM m""")
def _(spark, sf):
    board = evaluate.leaderboard(evaluate.holdout_metrics(_gapped(spark, sf, ("naive", "linear")), keys=["model"]))
    return board.select("model", "n", rounded("rmse", 3), "rank")


@query("mdl_13_run_workflow")
def _(spark, sf):
    job = Job("ds", "value", 7, "D", ("event_type",), strategy="keyed")
    result = run_workflow(panel(spark, sf), job, _as_of())
    return result.forecast


@query("dia_08_enhance_forecast")
def _(spark, sf):
    job = Job("ds", "value", 14, "D", ("series",), model="seasonal", strategy="keyed")
    made, diagnosed = forecast(order_panel(spark, sf), job, _as_of())
    return made.join(diagnosed.select("series", "health_score", "health_band", _codes("warnings")), "series")


def _reloaded(spark, days, kind):
    """A fitted model and the same one from its files."""
    settings = ModelSettings(kind, "ds", "value", 7, "D", ("series",), strategy="keyed")
    model = fit_model(days, settings, _boosted_config() if kind == "boosted" else None)
    path = fresh_path(spark, "model")
    model.save(path)
    return model, StoredModel.load(spark, path)


@query("mdl_14_predict_closed_forms", f"""WITH {ORDER_PANEL},
x AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM order_panel WINDOW w AS (PARTITION BY series ORDER BY ds)),
f AS (SELECT series, max(ds) AS last, max(n) AS n, arg_max(value, i) AS naive, regr_slope(value, i) AS s, regr_intercept(value, i) AS b,
        sum(value * CASE WHEN i = 0 THEN 1 ELSE 2 / 21.0::DOUBLE END * pow(19 / 21.0::DOUBLE, n - 1 - i)) AS level FROM x GROUP BY 1),
g AS (SELECT *, CAST(h AS INTEGER) AS step FROM f, range(1, 11) r(h))
SELECT series, step, last + to_days(step) AS ds, model_name,
  round(CASE model_name WHEN 'naive' THEN naive WHEN 'linear' THEN b + s * (n + step - 1) ELSE level END, 2) AS prediction
FROM g, (VALUES ('naive'), ('linear'), ('simple_ewm')) m(model_name)""")
def _(spark, sf):
    days = order_panel(spark, sf)
    made = [predict_existing(_reloaded(spark, days, kind)[1], horizon=10) for kind in baseline.BASELINES]
    rows = made[0].unionByName(made[1]).unionByName(made[2])
    return rows.select("series", "step", "ds", "model_name", rounded("prediction", 2))


@query("mdl_14_predict_seasonal", STEPS.format(model="seasonal", steps=11))
def _(spark, sf):
    days = order_panel(spark, sf)
    again = predict_existing(_reloaded(spark, days, "seasonal")[1], days, 10)
    direct = forecast_seasonal(days, "ds", "value", 10, "D", ["series"], strategy="keyed")
    first = direct.select("series", "step", F.col("prediction").alias("first"))
    same = F.abs(F.col("prediction") - F.col("first")) <= 1e-9 * (1 + F.abs("first"))
    return again.join(first, ["series", "step"]).select("series", "step", "ds", "model_name", same.alias("finite"))


@query("mdl_14_predict_existing", STEPS.format(model="boosted", steps=11))
def _(spark, sf):
    days = order_panel(spark, sf)
    model, again = _reloaded(spark, days, "boosted")
    again = predict_existing(again, days, 10)
    first = model.predict(10).select("series", "step", F.col("prediction").alias("first"))
    same = F.round(F.abs(F.col("prediction") - F.col("first")), 6) == 0
    return again.join(first, ["series", "step"]).select("series", "step", "ds", "model_name", same.alias("finite"))


@query("snk_05_save_model", f"""WITH {ORDER_PANEL},
x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i FROM order_panel)
SELECT series, round(regr_slope(value, i), 4) AS slope, round(regr_intercept(value, i), 4) AS intercept FROM x GROUP BY 1""")
def _(spark, sf):
    rows = evaluate.split_rows(order_panel(spark, sf), "ds", "value", ["series"], strategy="keyed")
    path = fresh_path(spark, "coefficients")
    sinks.save_coefficients(baseline.fit_baselines(rows.drop("n_train"), "value", ["series"], "idx", F.col("total")), path)
    return sinks.load_coefficients(spark, path).select("series", rounded("slope"), rounded("intercept"))


@query("snk_04_save_forecast", f"""WITH {PANEL}, l AS (SELECT event_type, max(ds) AS last, arg_max(value, ds) AS value FROM panel GROUP BY 1)
SELECT event_type, 'naive' AS model_name, CAST(h AS INTEGER) AS step, last + to_days(CAST(h AS INTEGER)) AS ds, round(value, 4) AS prediction FROM l, range(1, 8) r(h)""")
def _(spark, sf):
    made = baseline.forecast_baseline(panel(spark, sf), "ds", "value", 7, "naive", "D", ["event_type"], strategy="keyed")
    path = fresh_path(spark, "forecasts")
    sinks.save_forecast(made, path, "run-1")
    stored = spark.read.parquet(path).where(F.col("run_id") == "run-1")
    back = sinks.read_payload(sinks.forecast_payload(stored, ["event_type"]), keep=["event_type"])
    return back.select("event_type", "model_name", "step", "ds", rounded("prediction"))
