"""Queries: fills, windows, features and profiles.

Queries over raw rows force the banded way, which is the one a large table takes; queries
over daily panels use plain windows, since a series there has one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as fea
from tidemark.operators import profile as prf
from tidemark.operators import series as win
from tidemark.operators.aggregate import keep_last, resample
from tidemark.operators.fill import fill_missing, fix_frequency
from tidemark.operators.prepare import apply_preparation
from tidemark.plans.registry import GAPPY, ORDER_PANEL, PANEL, gappy, order_panel, panel, query, rounded, table

ROW_ORDER = ["ts", "event_id"]
W = "WINDOW w AS (ORDER BY ts, event_id)"
KW = "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"

# -- fills ------------------------------------------------------------------------------------


@query("fil_01_ffill", f"""WITH {GAPPY}
SELECT event_id, last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM gappy {W}""")
def _(spark, sf):
    return fill_missing(gappy(spark, sf), "value", "ffill", ROW_ORDER, strategy="banded").select("event_id", "value")


@query("fil_01_ffill_per_series", f"""WITH {GAPPY}
SELECT event_id, last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM gappy {KW}""")
def _(spark, sf):
    filled = fill_missing(gappy(spark, sf), "value", "ffill", ROW_ORDER, ["event_type"], strategy="banded")
    return filled.select("event_id", "value")


@query("fil_02_bfill", f"""WITH {GAPPY}
SELECT event_id, first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM gappy {W}""")
def _(spark, sf):
    return fill_missing(gappy(spark, sf), "value", "bfill", ROW_ORDER, strategy="banded").select("event_id", "value")


@query("fil_03_mean", f"""WITH {GAPPY}
SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM gappy""")
def _(spark, sf):
    return fill_missing(gappy(spark, sf), "value", "mean").select("event_id", rounded("value", 6))


@query("fil_04_median", f"""WITH {GAPPY}, m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM gappy GROUP BY 1)
SELECT event_id, round(coalesce(value, median), 6) AS value FROM gappy JOIN m USING (event_type)""")
def _(spark, sf):
    filled = fill_missing(gappy(spark, sf), "value", "median", keys=["event_type"], strategy="banded")
    return filled.select("event_id", rounded("value", 6))


@query("fil_05_zero", f"WITH {GAPPY} SELECT event_id, coalesce(value, 0) AS value FROM gappy")
def _(spark, sf):
    return fill_missing(gappy(spark, sf), "value", "zero").select("event_id", "value")


@query("fil_06_interpolate", f"""WITH {GAPPY},
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM gappy),
e AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY event_type ORDER BY i) AS pi,
             min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY event_type ORDER BY i DESC) AS ni FROM n)
SELECT e.event_id, round(CASE WHEN e.value IS NOT NULL THEN e.value
         ELSE p.value + (x.value - p.value) * (e.i - e.pi) / (e.ni - e.pi) END, 6) AS value
FROM e LEFT JOIN n p ON p.event_type = e.event_type AND p.i = e.pi LEFT JOIN n x ON x.event_type = e.event_type AND x.i = e.ni""")
def _(spark, sf):
    filled = fill_missing(gappy(spark, sf), "value", "interpolate", ROW_ORDER, ["event_type"], strategy="banded")
    return filled.select("event_id", rounded("value", 6))


@query("fil_07_value", f"WITH {GAPPY} SELECT event_id, coalesce(value, 12.5) AS value FROM gappy")
def _(spark, sf):
    return fill_missing(gappy(spark, sf), "value", "12.5").select("event_id", "value")


@query("fil_08_drop", f"WITH {GAPPY} SELECT event_id, value FROM gappy WHERE value IS NOT NULL")
def _(spark, sf):
    return fill_missing(gappy(spark, sf), "value", "drop").select("event_id", "value")


@query("fil_09_fix_frequency", f"""WITH {ORDER_PANEL},
s AS (SELECT series, min(ds) AS lo, max(ds) AS hi FROM order_panel GROUP BY 1),
g AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ds FROM s),
j AS (SELECT g.series, g.ds, p.value FROM g LEFT JOIN order_panel p USING (series, ds))
SELECT series, ds, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value
FROM j""")
def _(spark, sf):
    fixed = fix_frequency(order_panel(spark, sf), "ds", "D", ["series"])
    return fixed.select("series", "ds", rounded("value"))


@query("fil_09_fix_frequency_hourly", """WITH h AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, sum(value) AS value FROM events WHERE hour(ts) % 3 <> 1 GROUP BY 1),
s AS (SELECT min(ts) AS lo, max(ts) AS hi FROM h), g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM s)
SELECT g.ts, round(last_value(h.value IGNORE NULLS) OVER (ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value FROM g LEFT JOIN h USING (ts)""")
def _(spark, sf):
    hours = resample(table(spark, sf, "events").where(F.hour("ts") % 3 != 1), "ts", "H", "sum", "value")
    return fix_frequency(hours, "ts", "H").select("ts", rounded("value"))


# -- windows ------------------------------------------------------------------------------------


@query("win_01_lag", f"""
SELECT event_id, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7, lag(value, 30) OVER w AS lag_30 FROM events {W}""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "value")
    made = win.lags(events, "value", ROW_ORDER, [1, 7, 30], strategy="banded")
    return made.select("event_id", "lag_1", "lag_7", "lag_30")


@query("win_02_rolling_mean", f"""
SELECT event_id, round(avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling_mean_7,
       round(avg(value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS rolling_mean_30 FROM events {KW}""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    made = win.rolling(events, "value", ROW_ORDER, [7, 30], ["event_type"], ["mean"], strategy="banded")
    return made.select("event_id", rounded("rolling_mean_7", 6), rounded("rolling_mean_30", 6))


@query("win_03_rolling_std", f"""
SELECT event_id, round(stddev_samp(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 5) AS rolling_std_7 FROM events {KW}""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    made = win.rolling(events, "value", ROW_ORDER, [7], ["event_type"], ["std"], strategy="banded")
    return made.select("event_id", rounded("rolling_std_7", 5))


@query("win_04_trend", f"SELECT event_id, row_number() OVER w - 1 AS trend FROM events {KW}")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return win.trend(events, ROW_ORDER, ["event_type"], strategy="banded").select("event_id", "trend")


@query("win_04_trend_unkeyed", f"SELECT event_id, row_number() OVER w - 1 AS trend FROM events {W}")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return win.trend(events, ROW_ORDER, strategy="banded").select("event_id", "trend")


@query("win_05_deltas", f"""
SELECT event_id, epoch_us(ts - lag(ts) OVER w) / 1e6 AS delta_seconds FROM events {W}""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return win.deltas(events, "ts", (), ["event_id"], strategy="banded").select("event_id", "delta_seconds")


@query("win_06_frequency_gaps", f"""WITH {ORDER_PANEL},
d AS (SELECT series, epoch(ds - lag(ds) OVER (PARTITION BY series ORDER BY ds)) AS delta FROM order_panel),
c AS (SELECT series, delta, count(*) AS n FROM d WHERE delta IS NOT NULL GROUP BY 1, 2),
m AS (SELECT series, arg_max(delta, n * 1e9 - delta) AS mode_seconds, max(n) AS top, sum(n) AS total FROM c GROUP BY 1)
SELECT series, CAST(mode_seconds AS DOUBLE) AS mode_seconds, CAST(total - top AS BIGINT) AS frequency_gaps,
       round(CAST(total - top AS DOUBLE) * 100.0 / CAST(total AS DOUBLE), 2)::DOUBLE AS frequency_gap_pct FROM m""")
def _(spark, sf):
    return win.frequency_gaps(order_panel(spark, sf), "ds", ["series"], strategy="keyed").drop("intervals")


@query("win_07_holdout_split", f"""
SELECT event_id, row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY event_type) * 0.8::DOUBLE) AS is_train FROM events {KW}""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return win.holdout_split(events, ROW_ORDER, ["event_type"], strategy="banded").select("event_id", "is_train")


@query("win_08_keep_last", """
SELECT o_orderkey, o_orderdate, o_orderpriority, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey DESC) = 1""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    return keep_last(orders, "o_orderdate", "o_orderkey", ["o_orderpriority"])


RESIDUAL = f"""{PANEL}, r AS (
  SELECT event_type, ds, value - avg(value) OVER (PARTITION BY event_type) AS residual,
         row_number() OVER (PARTITION BY event_type ORDER BY ds) - 1 AS i FROM panel)"""


def _residuals(spark, sf):
    days = panel(spark, sf)
    means = days.groupBy("event_type").agg(F.avg("value").alias("mean"))
    return days.join(means, "event_type").select("event_type", "ds", (F.col("value") - F.col("mean")).alias("residual"))


@query("win_09_residual_autocorrelation", f"""WITH {RESIDUAL},
l AS (SELECT event_type, residual, lag(residual) OVER (PARTITION BY event_type ORDER BY ds) AS before FROM r)
SELECT event_type, round(corr(residual, before), 6) AS autocorr_lag1 FROM l GROUP BY 1""")
def _(spark, sf):
    made = win.residual_autocorrelation(_residuals(spark, sf), "residual", "ds", ["event_type"], strategy="keyed")
    return made.select("event_type", rounded("autocorr_lag1", 6))


@query("win_10_residual_trend", f"""WITH {RESIDUAL}
SELECT event_type, round(regr_slope(residual, i), 6) AS slope,
       count(*) >= 10 AND abs(regr_slope(residual, i)) > 0.1 * stddev_pop(residual) AS has_trend FROM r GROUP BY 1""")
def _(spark, sf):
    made = win.residual_trend(_residuals(spark, sf), "residual", "ds", ["event_type"], strategy="keyed")
    return made.select("event_type", rounded("slope", 6), "has_trend")


ACF = f"""{ORDER_PANEL}, x AS (
  SELECT series, row_number() OVER (PARTITION BY series ORDER BY ds) AS i, count(*) OVER (PARTITION BY series) AS n,
         value - avg(value) OVER (PARTITION BY series) AS x FROM order_panel)"""


@query("win_11_acf", f"""WITH {ACF}, k AS (SELECT unnest([7, 14, 30, 365]) AS lag),
p AS (SELECT series, sum(x * x) AS power FROM x GROUP BY 1)
SELECT a.series, CAST(k.lag AS INTEGER) AS lag, round(coalesce(sum(a.x * b.x), 0) / min(p.power), 6) AS acf
FROM x a CROSS JOIN k LEFT JOIN x b ON a.series = b.series AND b.i = a.i + k.lag JOIN p ON p.series = a.series GROUP BY 1, 2""")
def _(spark, sf):
    made = win.autocorrelation(order_panel(spark, sf), "value", "ds", [7, 14, 30, 365], ["series"], "keyed")
    return made.select("series", F.inline("acf").alias("lag", "acf")).withColumn("acf", F.round("acf", 6))


@query("win_11_seasonality", f"""WITH {ACF}, k AS (SELECT unnest(range(2, 366)) AS lag),
p AS (SELECT series, sum(x * x) AS power FROM x GROUP BY 1),
s AS (SELECT a.series, k.lag, sum(a.x * b.x) / min(p.power) AS acf, min(a.n) AS n
      FROM x a CROSS JOIN k JOIN x b ON a.series = b.series AND b.i = a.i + k.lag JOIN p ON p.series = a.series GROUP BY 1, 2),
c AS (SELECT series,
        min(CASE WHEN acf > 0.3 AND lag IN (7, 14, 30, 365) AND lag < n THEN lag END) AS candidate,
        min(CASE WHEN acf > 0.3 AND lag < least(n // 2, 365) THEN lag END) AS scanned FROM s GROUP BY 1)
SELECT series, coalesce(candidate, scanned) IS NOT NULL AS has_seasonality, CAST(coalesce(candidate, scanned) AS INTEGER) AS seasonality_period FROM c""")
def _(spark, sf):
    return win.seasonality(order_panel(spark, sf), "value", "ds", "D", ["series"], "keyed")


@query("win_12_trend_concordance", f"""WITH {ORDER_PANEL}, x AS (
  SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM order_panel),
c AS (SELECT series, i, value, n FROM x)
SELECT a.series, min(a.n) AS n, round(avg(sign(b.value - a.value)), 6) AS concordance, abs(avg(sign(b.value - a.value))) > 0.3 AS has_trend
FROM c a JOIN c b ON a.series = b.series AND a.i < b.i GROUP BY 1""")
def _(spark, sf):
    made = win.trend_concordance(order_panel(spark, sf), "value", "ds", ["series"], "keyed")
    return made.select("series", "n", rounded("concordance", 6), "has_trend")


EWM = f"""{PANEL}, x AS (
  SELECT event_type, ds, value, row_number() OVER (PARTITION BY event_type ORDER BY ds) - 1 AS i FROM panel)"""


@query("win_13_ewm_mean", f"""WITH {EWM}
SELECT a.event_type, a.ds, round(sum(b.value * (CASE WHEN b.i = 0 THEN 1 ELSE 0.3::DOUBLE END) * power(0.7::DOUBLE, a.i - b.i)), 4) AS ewm_mean
FROM x a JOIN x b ON a.event_type = b.event_type AND b.i <= a.i GROUP BY 1, 2""")
def _(spark, sf):
    made = win.ewm_mean(panel(spark, sf), "value", "ds", ["event_type"], alpha=0.3, strategy="banded")
    return made.select("event_type", "ds", rounded("ewm_mean"))


SPARSE = f"""WITH {ORDER_PANEL},
s AS (SELECT series, ds, CASE WHEN month(ds) IN (1, 6, 7) THEN value END AS value FROM order_panel),
k AS (SELECT *, count(value) OVER (PARTITION BY series ORDER BY ds) AS k FROM s),
v AS (SELECT series, k, value FROM k WHERE value IS NOT NULL),
l AS (SELECT a.series, a.k, sum(b.value * (CASE WHEN b.k = 1 THEN 1 ELSE 0.01::DOUBLE END) * power(0.99::DOUBLE, a.k - b.k)) AS level
      FROM v a JOIN v b ON a.series = b.series AND b.k <= a.k GROUP BY 1, 2)"""


@query("win_13_ewm_mean_sparse", f"""{SPARSE}
SELECT k.series, k.ds, round(l.level, 3) AS ewm_mean FROM k LEFT JOIN l ON k.series = l.series AND k.k = l.k""")
def _(spark, sf):
    days = order_panel(spark, sf).withColumn("value", F.when(F.month("ds").isin(1, 6, 7), F.col("value")))
    made = win.ewm_mean(days, "value", "ds", ["series"], alpha=0.01)
    return made.select("series", "ds", rounded("ewm_mean", 3))


@query("mdl_05_ewm_level", f"""WITH {EWM}, n AS (SELECT event_type, max(i) AS last FROM x GROUP BY 1)
SELECT event_type, round(sum(value * (CASE WHEN i = 0 THEN 1 ELSE 2::DOUBLE / 21 END) * power(19::DOUBLE / 21, last - i)), 4) AS level
FROM x JOIN n USING (event_type) GROUP BY 1""")
def _(spark, sf):
    made = win.ewm_level(panel(spark, sf), "value", "ds", ["event_type"], span=20, strategy="keyed")
    return made.select("event_type", rounded("level"))


# -- features -------------------------------------------------------------------------------------


@query("fea_01_create_features", f"""WITH {ORDER_PANEL}
SELECT series, ds, round(lag(value, 1) OVER w, 4) AS lag_1, round(lag(value, 7) OVER w, 4) AS lag_7, round(lag(value, 30) OVER w, 4) AS lag_30,
       round(avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolling_mean_7,
       round(stddev_samp(value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 3) AS rolling_std_30,
       row_number() OVER w - 1 AS trend, CAST(isodow(ds) AS INTEGER) AS day_of_week, CAST(month(ds) AS INTEGER) AS month, CAST(day(ds) AS INTEGER) AS day_of_month
FROM order_panel WINDOW w AS (PARTITION BY series ORDER BY ds)""")
def _(spark, sf):
    made = fea.create_features(order_panel(spark, sf), "ds", "value", keys=["series"], strategy="keyed")
    return made.select(
        "series", "ds", *[rounded(c) for c in ("lag_1", "lag_7", "lag_30", "rolling_mean_7")],
        rounded("rolling_std_30", 3), "trend", "day_of_week", "month", "day_of_month",
    )


FEATURES = """f AS (
  SELECT event_id, event_type, value, lag(value, 1) OVER w AS lag_1, avg(value) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS rolling_mean_14,
         stddev_samp(value) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS rolling_std_14,
         CAST(isodow(ts) AS INTEGER) AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN CAST(ts AS DATE) IN (SELECT CAST(date_trunc('week', ts) AS DATE) FROM events) THEN 1 ELSE 0 END AS is_holiday
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""


def _specs():
    return [
        fea.lag_spec(1), *fea.rolling_specs(14), fea.part_spec("dayofweek"), fea.part_spec("is_weekend"),
        fea.FeatureSpec("is_holiday", "holiday"),
    ]


def _mondays(spark, sf):
    return table(spark, sf, "events").select(F.to_date(F.date_trunc("week", "ts")).alias("date")).distinct()


@query("fea_02_apply_features", f"""WITH {FEATURES}
SELECT event_id, lag_1, round(rolling_mean_14, 5) AS rolling_mean_14, round(rolling_std_14, 5) AS rolling_std_14, day_of_week, is_weekend, is_holiday FROM f""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    made = fea.apply_features(
        events, _specs(), "ts", "value", ["event_type"], ["event_id"], _mondays(spark, sf), strategy="banded"
    )
    return made.select(
        "event_id", "lag_1", rounded("rolling_mean_14", 5), rounded("rolling_std_14", 5), "day_of_week", "is_weekend", "is_holiday"
    )


NAMES = ("lag_1", "rolling_mean_14", "rolling_std_14", "day_of_week", "is_weekend", "is_holiday")


@query("fea_05_feature_impact", f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(abs(corr(value, {n})), 3) AS impact FROM f" for n in NAMES))
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return fea.feature_impact(
        events, _specs(), "ts", "value", ["event_type"], ["event_id"], _mondays(spark, sf), strategy="banded"
    )


@query("srt_06_top_features", f"WITH {FEATURES}, i AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(abs(corr(value, {n})), 3) AS impact FROM f" for n in NAMES)
    + ") SELECT feature, impact FROM i ORDER BY impact DESC NULLS LAST, feature LIMIT 5")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return fea.top_features(fea.feature_impact(
        events, _specs(), "ts", "value", ["event_type"], ["event_id"], _mondays(spark, sf), strategy="banded"
    ))


@query("fea_03_select_features", f"""WITH {ORDER_PANEL}, c AS (SELECT count(DISTINCT ds) AS n FROM order_panel)
SELECT k AS feature FROM c, (VALUES ('lag_1', 1, 3), ('lag_7', 7, 3), ('lag_14', 14, 3), ('lag_30', 30, 3),
  ('rolling_mean_7', 7, 4), ('rolling_std_7', 7, 4), ('rolling_mean_14', 14, 4), ('rolling_std_14', 14, 4),
  ('rolling_mean_30', 30, 4), ('rolling_std_30', 30, 4), ('day_of_week', 0, 1), ('is_weekend', 0, 1), ('month', 0, 1), ('day_of_month', 0, 1)) v(k, size, part)
WHERE size <= greatest(1, n // part)""")
def _(spark, sf):
    n = order_panel(spark, sf).select("ds").distinct().count()
    specs = fea.suggest_specs("D", n)
    return spark.createDataFrame([(s.name,) for s in specs], "feature string")


@query("fea_04_configure_features", f"""WITH {ORDER_PANEL}, g AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM order_panel GROUP BY series)),
v(kind, size) AS (VALUES ('lag', 3), ('lag', 10), ('lag', 17), ('lag', 31), ('window', 7), ('window', 14))
SELECT kind, size FROM v, g WHERE size < greatest(10, m // 3)""")
def _(spark, sf):
    sizes = order_panel(spark, sf).groupBy("series").count().agg(F.sum("count"), F.min("count")).first()
    config = fea.configure_features("D", 2, sizes[0], sizes[1])
    rows = [("lag", k) for k in config["lags"]] + [("window", w) for w in config["rolling_windows"]]
    return spark.createDataFrame(rows, "kind string, size int")


# -- profiles ---------------------------------------------------------------------------------------

PROFILE = """SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) - count({c}) AS n_missing,
  count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique, {d} AS is_datetime, {n} AS is_numeric FROM gappy"""


@query("prf_01_profile_columns", f"WITH {GAPPY} " + " UNION ALL ".join(
    PROFILE.format(c=c, t=t, d=d, n=n) for c, t, d, n in (
        ("event_id", "bigint", "false", "true"), ("ts", "timestamp_ntz", "true", "false"), ("event_type", "string", "false", "false"),
        ("user_id", "bigint", "false", "true"), ("value", "double", "false", "true"))))
def _(spark, sf):
    return prf.profile_columns(gappy(spark, sf)).drop("sample_values")


@query("prf_02_detect_datetime", "SELECT 'ts' AS typed, 'day' AS parsed, count(*) AS n FROM events")
def _(spark, sf):
    events = table(spark, sf, "events")
    text = events.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    found = F.lit(prf.detect_datetime(events)).alias("typed"), F.lit(prf.detect_datetime(text)).alias("parsed")
    return events.agg(F.count(F.lit(1)).alias("n")).select(*found, "n")


@query("prf_03_detect_target", "SELECT 'value' AS target, round(sum(value), 4) AS total FROM events")
def _(spark, sf):
    events = table(spark, sf, "events")
    target = prf.detect_target(events, "ts")
    return events.agg(F.round(F.sum(target), 4).alias("total")).select(F.lit(target).alias("target"), "total")


FREQUENCY = """d AS (SELECT event_type, epoch_us(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1e6 AS delta FROM events),
m AS (SELECT event_type, quantile_cont(delta, 0.5) AS med, count(*) AS n FROM d GROUP BY 1)"""


@query("prf_04_infer_frequency", f"""WITH {FREQUENCY}
SELECT event_type, round(med, 4) AS median_seconds,
       CASE WHEN n < 3 OR med <= 0 THEN NULL WHEN abs(med - 60) < 5 THEN 'T' WHEN abs(med - 3600) < 120 THEN 'H' WHEN abs(med - 86400) < 1800 THEN 'D'
            WHEN abs(med - 604800) < 43200 THEN 'W' WHEN med BETWEEN 2160000 AND 3024000 THEN 'M' ELSE CAST(floor(med) AS BIGINT) || 's' END AS frequency
FROM m""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    made = prf.infer_frequency(events, "ts", ["event_type"], strategy="banded")
    return made.select("event_type", rounded("median_seconds"), "frequency")


@query("prf_04_infer_frequency_daily", "SELECT DISTINCT event_type, 86400.0::DOUBLE AS median_seconds, 'D' AS frequency FROM events")
def _(spark, sf):
    return prf.infer_frequency(panel(spark, sf), "ds", ["event_type"], strategy="keyed")


@query("prf_05_validate_series", """
SELECT false AS valid, count(*) AS n_points, false AS has_missing, 0::BIGINT AS n_missing, count(*) > count(DISTINCT o_orderdate) AS has_duplicates,
       'Duplicate timestamps found' AS errors FROM orders""")
def _(spark, sf):
    made = prf.validate_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return made.withColumn("errors", F.concat_ws("|", "errors"))


@query("prf_06_identify_issues", f"""WITH {GAPPY}
SELECT 'missing' AS issue, 'value' AS subject, count(*) - count(value) AS amount FROM gappy
UNION ALL SELECT 'duplicates', 'event_type', count(*) - count(DISTINCT event_type) FROM gappy""")
def _(spark, sf):
    return prf.identify_issues(gappy(spark, sf), "event_type")


QUALITY = f"""WITH {GAPPY}, m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd FROM gappy GROUP BY 1)
SELECT event_type, count(*) AS total_rows, count(*) - count(value) AS missing_count, round(100.0 * (count(*) - count(value)) / count(*), 4) AS missing_pct,
       round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max,
       count(*) FILTER (WHERE abs(value - mean) / sd > 3) AS outliers_count,
       round(100.0 * count(*) FILTER (WHERE abs(value - mean) / sd > 3) / count(value), 4) AS outliers_pct,
       CAST(floor(epoch(TIMESTAMP '2024-03-01 00:00:00' - max(ts)) / 86400) AS INTEGER) AS data_age_days, CAST(max(ts) AS DATE) AS last_data_date
FROM gappy JOIN m USING (event_type) GROUP BY 1"""


@query("prf_11_data_quality", QUALITY)
def _(spark, sf):
    as_of = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    made = prf.data_quality(gappy(spark, sf), "ts", "value", as_of, ["event_type"])
    return made.withColumns({c: F.round(c, 4) for c in ("missing_pct", "mean", "std", "outliers_pct")})


PROFILED = f"""WITH {ACF}, k AS (SELECT unnest(range(2, 366)) AS lag),
p AS (SELECT series, sum(x * x) AS power FROM x GROUP BY 1),
s AS (SELECT a.series, k.lag, sum(a.x * b.x) / min(p.power) AS acf, min(a.n) AS n
      FROM x a CROSS JOIN k JOIN x b ON a.series = b.series AND b.i = a.i + k.lag JOIN p ON p.series = a.series GROUP BY 1, 2),
c AS (SELECT series,
        min(CASE WHEN acf > 0.3 AND lag IN (7, 14, 30, 365) AND lag < n THEN lag END) AS candidate,
        min(CASE WHEN acf > 0.3 AND lag < least(n // 2, 365) THEN lag END) AS scanned FROM s GROUP BY 1),
season AS (SELECT series, CAST(coalesce(candidate, scanned) AS INTEGER) AS period FROM c),
spaced AS (SELECT series, i, x AS v FROM x),
trend AS (SELECT a.series, abs(avg(sign(b.v - a.v))) > 0.3 AS has_trend FROM spaced a JOIN spaced b ON a.series = b.series AND a.i < b.i GROUP BY 1),
gap AS (SELECT series, quantile_cont(d, 0.5) AS med FROM (
        SELECT series, epoch(ds - lag(ds) OVER (PARTITION BY series ORDER BY ds)) AS d FROM order_panel) GROUP BY 1),
q AS (SELECT series, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM order_panel GROUP BY 1),
o AS (SELECT series, count(*) AS n_rows, CAST(min(ds) AS DATE) AS start_date, CAST(max(ds) AS DATE) AS end_date,
        round(100.0 * count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(value), 2) AS outlier_pct
      FROM order_panel JOIN q USING (series) GROUP BY 1)
SELECT series, n_rows, 0.0::DOUBLE AS missing_pct,
       CASE WHEN abs(med - 86400) < 1800 THEN 'D' WHEN abs(med - 604800) < 43200 THEN 'W' WHEN med BETWEEN 2160000 AND 3024000 THEN 'M'
            ELSE CAST(floor(med) AS BIGINT) || 's' END AS frequency, start_date, end_date, outlier_pct, period IS NOT NULL AS has_seasonality,
       period AS seasonality_period, has_trend, CASE WHEN outlier_pct > 2 THEN 'handle_outliers:clip_iqr:' || CASE WHEN outlier_pct < 10 THEN 'medium' ELSE 'high' END ELSE '' END AS recommendations,
       outlier_pct > 5 AS needs_confirmation
FROM o JOIN season USING (series) JOIN trend USING (series) JOIN gap USING (series)"""


@query("prf_07_series_profile", PROFILED)
def _(spark, sf):
    made = prf.series_profile(order_panel(spark, sf), "ds", "value", "D", ["series"], "keyed")
    codes = F.concat_ws("|", F.transform("recommendations", lambda r: F.concat_ws(":", r["type"], r["method"], r["severity"])))
    return made.withColumn("recommendations", codes)


@query("prf_08_wizard_analysis", f"""WITH {GAPPY},
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean FROM gappy),
d AS (SELECT epoch_us(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS delta, event_type FROM gappy),
c AS (SELECT event_type, delta, count(*) AS n FROM d WHERE delta IS NOT NULL GROUP BY 1, 2),
g AS (SELECT sum(total - top) AS gaps, sum(total) AS total FROM (SELECT event_type, sum(n) AS total, max(n) AS top FROM c GROUP BY 1)),
s AS (SELECT count(*) AS n_groups, min(n) AS lo, max(n) AS hi FROM (SELECT event_type, count(*) AS n FROM gappy GROUP BY 1))
SELECT count(*) AS n_rows, count(*) - count(value) AS missing, round(100.0 * (count(*) - count(value)) / count(*), 2) AS missing_pct,
       round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers,
       round(avg((value - q.mean) ** 3) / avg((value - q.mean) ** 2) ** 1.5, 4) AS skewness,
       CAST(min(g.gaps) AS BIGINT) AS frequency_gaps, round(CAST(min(g.gaps) AS DOUBLE) * 100.0 / CAST(min(g.total) AS DOUBLE), 2)::DOUBLE AS frequency_gap_pct,
       count(*) - count(DISTINCT (event_type, ts)) AS n_duplicates, min(s.n_groups) AS n_groups, min(s.lo) AS min_group_size, min(s.hi) AS max_group_size,
       'missing_target,frequency_gaps,stale_data' AS issues
FROM gappy, q, g, s""")
def _(spark, sf):
    as_of = F.lit("2024-03-15 00:00:00").cast("timestamp_ntz")
    made = prf.wizard_analysis(gappy(spark, sf), "ts", "value", as_of, ["event_type"], strategy="banded")
    return made.select(
        "n_rows", "missing", "missing_pct", "mean", "std", "outliers", "skewness", "frequency_gaps", "frequency_gap_pct",
        "n_duplicates", "n_groups", "min_group_size", "max_group_size",
        F.concat_ws(",", F.transform("issues", lambda i: i["id"])).alias("issues"),
    )


@query("prf_09_suggest_preparations", f"""WITH {GAPPY},
b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM gappy GROUP BY 1),
s AS (SELECT event_type, 100.0 * (count(*) - count(value)) / count(*) AS miss, 100.0 * count(*) FILTER (WHERE value = 0) / count(value) AS zeros,
        round(100.0 * count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(value), 2) AS outs, min(q3 - q1) * 4 AS width
      FROM gappy JOIN b USING (event_type) GROUP BY 1)
SELECT event_type, CASE WHEN miss > 20 THEN 'drop' WHEN miss > 5 THEN 'interpolate' WHEN miss > 0 THEN 'forward_fill' ELSE 'none' END AS fill_choice,
       CASE WHEN outs <= 5 THEN 'none' WHEN zeros > 50 OR width < 0.01 THEN 'keep' WHEN outs > 20 THEN 'remove' WHEN outs > 10 THEN 'clip' ELSE 'keep' END AS outlier_choice FROM s""")
def _(spark, sf):
    from tidemark.operators.aggregate import iqr_outliers, target_stats

    source = gappy(spark, sf)
    stats = target_stats(source, "value", ["event_type"])
    fences = iqr_outliers(source, "value", ["event_type"], 11)
    made = prf.suggest_preparation_columns(stats.join(fences, "event_type"))
    return made.select("event_type", "fill_choice", "outlier_choice")


@query("prf_10_apply_preparation", f"""WITH {GAPPY},
p AS (SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, avg(value) AS value FROM gappy WHERE value IS NOT NULL GROUP BY 1, 2),
b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM p GROUP BY 1)
SELECT event_type, ts, round(CASE WHEN n > 10 AND 4 * (q3 - q1) >= 0.01 THEN least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) ELSE value END, 7) AS value
FROM p JOIN b USING (event_type)""")
def _(spark, sf):
    days = gappy(spark, sf).select("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "value")
    steps = [
        prf.PreparationStep("fill_missing", "drop", ()),
        prf.PreparationStep("handle_duplicates", "aggregate_mean", ()),
        prf.PreparationStep("handle_outliers", "clip", ()),
        prf.PreparationStep("fill_missing", "skip", ()),
    ]
    made = apply_preparation(days, steps, "ts", "value", "D", ["event_type"])
    # The offset keeps means that end on an exact half from being rounded either way.
    return made.select("event_type", "ts", rounded(F.col("value"), 7, "value"))


@query("agg_02_resample_total_kept", """
SELECT event_type, round(sum(value), 4) AS value FROM events GROUP BY 1""")
def _(spark, sf):
    hourly = resample(table(spark, sf, "events"), "ts", "6H", "sum", "value", ["event_type"])
    return hourly.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("value"))
