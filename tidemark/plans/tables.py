"""Queries: projections, filters, sorts, aggregations, joins, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.calendar import date_part
from tidemark.functions.columns import unique_id
from tidemark.functions.frequency import shift_periods
from tidemark.operators import aggregate as agg
from tidemark.operators import join as joins
from tidemark.operators import project as prj
from tidemark.operators.prepare import apply_linked, apply_operations, execute_operation
from tidemark.plans.registry import GAPPY, SPIKY, gappy, order_panel, query, rounded, spiky, table

# -- projections and filters --------------------------------------------------------------


@query("prj_01_to_series", f"""WITH {GAPPY}
SELECT event_type, ts, value FROM gappy WHERE value IS NOT NULL""")
def _(spark, sf):
    return prj.to_series(gappy(spark, sf), "ts", "value", ["event_type"])


@query("prj_02_drop_columns", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(spark, sf):
    return prj.drop_columns(table(spark, sf, "events"), ["props", "not_there"])


@query("prj_03_rename_columns", """
SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def _(spark, sf):
    return prj.rename_columns(table(spark, sf, "customer"), {"c_custkey": "id", "c_name": "name"})


@query("prj_04_add_column", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem""")
def _(spark, sf):
    made = prj.add_column(table(spark, sf, "lineitem"), "net", "l_extendedprice * (1 - l_discount)")
    return made.select("l_orderkey", "l_linenumber", "net")


@query("prj_05_cast_types", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number,
       TRY_CAST(CASE WHEN event_id % 13 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS stamp
FROM events""")
def _(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("number"),
        F.when(F.col("event_id") % 13 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("stamp"),
    )
    return prj.cast_types(text, {"number": "numeric", "stamp": "datetime"})


@query("prj_06_combine_datetime", """
SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS datetime FROM events""")
def _(spark, sf):
    split = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", "HH:mm:ss").alias("t")
    )
    return prj.combine_datetime(split, "d", "t", drop_original=True)


@query("prj_07_filter", "SELECT * FROM orders WHERE o_totalprice >= 250000")
def _(spark, sf):
    return prj.filter_rows(table(spark, sf, "orders"), "o_totalprice", ">=", "250000")


@query("prj_08_filter_date_range", """
SELECT event_id, ts, value FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'""")
def _(spark, sf):
    kept = prj.filter_date_range(table(spark, sf, "events"), "2024-01-05", "2024-01-12T12:00:00Z", "ts")
    return kept.select("event_id", "ts", "value")


@query("prj_09_drop_missing", f"""WITH {GAPPY}
SELECT event_id, value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id
FROM gappy WHERE value IS NOT NULL OR event_id % 5 <> 0""")
def _(spark, sf):
    holes = gappy(spark, sf).select(
        "event_id", "value", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id")
    )
    return prj.drop_missing(holes, min_non_null=2)


@query("prj_09_drop_missing_fraction", f"""WITH {GAPPY}
SELECT event_id, value, user_id FROM gappy WHERE value IS NOT NULL""")
def _(spark, sf):
    return prj.drop_missing(gappy(spark, sf).select("event_id", "value", "user_id"), min_fraction=1.0)


@query("prj_10_clip_negative", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def _(spark, sf):
    return prj.clip_negative(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


FENCES = """fences AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM spiky GROUP BY event_type),
bounds AS (
  SELECT event_type, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM fences)"""


@query("prj_11_clip_outliers", f"""WITH {SPIKY}, {FENCES}
SELECT s.event_id, round(least(greatest(s.value, b.lower), b.upper), 4) AS value
FROM spiky s JOIN bounds b USING (event_type)""")
def _(spark, sf):
    clipped = prj.handle_outliers(spiky(spark, sf), "value", "clip", ["event_type"])
    return clipped.select("event_id", rounded("value"))


@query("prj_12_remove_outliers", f"""WITH {SPIKY}, {FENCES}
SELECT s.event_id, round(s.value, 4) AS value
FROM spiky s JOIN bounds b USING (event_type) WHERE s.value BETWEEN b.lower AND b.upper""")
def _(spark, sf):
    kept = prj.handle_outliers(spiky(spark, sf), "value", "remove", ["event_type"], strategy="banded")
    return kept.select("event_id", rounded("value"))


@query("prj_13_normalize", """
SELECT c_custkey,
       round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS scaled,
       round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z
FROM customer""")
def _(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    both = prj.normalize(prj.normalize(customer, "c_acctbal", "min_max", "scaled"), "c_acctbal", "z_score", "z")
    return both.select("c_custkey", rounded("scaled", 6), rounded("z", 6))


@query("prj_13_normalize_per_series", """
SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled
FROM events WINDOW w AS (PARTITION BY event_type)""")
def _(spark, sf):
    made = prj.normalize(table(spark, sf, "events"), "value", "min_max", "scaled", ["event_type"])
    return made.select("event_id", rounded("scaled", 6))


@query("prj_14_unique_id", """
SELECT o_orderkey, o_orderstatus || '_' || o_orderpriority AS unique_id FROM orders""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", unique_id(["o_orderstatus", "o_orderpriority"]).alias("unique_id"))


@query("prj_15_filter_series", """
SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def _(spark, sf):
    return prj.filter_series(table(spark, sf, "orders"), {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"})


@query("prj_18_drop_non_numeric_target", """
SELECT event_id, value AS target, ts FROM events WHERE event_id % 11 <> 0""")
def _(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("target"),
        "ts",
    )
    return prj.drop_non_numeric_target(text, "target", "ts")


@query("prj_19_apply_linked", """
SELECT event_type, count(*) AS n FROM events WHERE value > 200 GROUP BY event_type
UNION ALL
SELECT 'linked' AS event_type, count(*) AS n FROM (SELECT user_id, avg(value) AS value FROM events GROUP BY user_id) WHERE value > 200
UNION ALL
SELECT 'unrelated' AS event_type, count(*) AS n FROM orders""")
def _(spark, sf):
    events = table(spark, sf, "events")
    linked = {"linked": agg.aggregate(events, "user_id", "value"), "unrelated": table(spark, sf, "orders")}
    main, others = apply_linked("filter", {"column": "value", "condition": ">", "value": 200}, events, linked)
    out = main.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    for name, df in others.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("event_type"), "n"))
    return out


@query("prf_12_execute_operation", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(sum(value), 4) AS value
FROM events WHERE event_type <> 'error' AND value >= 1 GROUP BY 1""")
def _(spark, sf):
    out = apply_operations(
        table(spark, sf, "events"),
        [
            ("filter", {"column": "event_type", "condition": "!=", "value": "error"}),
            ("filter", {"column": "value", "condition": ">=", "value": "1"}),
            ("resample", {"datetime_column": "ts", "value_columns": "value", "frequency": "D", "agg_function": "sum"}),
        ],
    )
    failed = execute_operation(out, "filter", {"column": "nope", "condition": ">", "value": 1})
    return failed.df.select("ts", rounded("value"))


@query("udf_01_user_expression", """
SELECT event_type, round(sum(CASE WHEN value > 100 THEN value * 2 ELSE 0 END), 4) AS boosted FROM events GROUP BY event_type""")
def _(spark, sf):
    made = prj.add_column(table(spark, sf, "events"), "boosted", "CASE WHEN value > 100 THEN value * 2 ELSE 0 END")
    return made.groupBy("event_type").agg(rounded(F.sum("boosted"), 4, "boosted"))


# -- sorts and pages ------------------------------------------------------------------------


@query("srt_01_sort", f"""WITH {GAPPY} SELECT event_id, value FROM gappy ORDER BY value DESC NULLS FIRST, event_id""")
def _(spark, sf):
    return prj.sort_rows(gappy(spark, sf).select("event_id", "value"), "value", False, ["event_id"])


@query("srt_02_head", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100")
def _(spark, sf):
    return prj.head(table(spark, sf, "lineitem"), 100, ["l_orderkey", "l_linenumber"])


@query("srt_03_page", """
SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500 OFFSET 40""")
def _(spark, sf):
    return prj.page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 500, 40, ["o_orderkey"])


@query("src_05_row_limit", "SELECT event_id, ts FROM events ORDER BY event_id LIMIT 1000")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts").orderBy("event_id").limit(1000)


@query("src_08_preview", "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 10000")
def _(spark, sf):
    from tidemark.sources.files import preview

    return preview(table(spark, sf, "part").select("p_partkey", "p_brand"), 10_000, ["p_partkey"])


# -- aggregations -----------------------------------------------------------------------------


@query("agg_01_aggregate", f"""WITH {GAPPY}
SELECT event_type, 'mean' AS fn, round(avg(value), 6) AS value FROM gappy GROUP BY event_type UNION ALL
SELECT event_type, 'sum', round(sum(value), 6) FROM gappy GROUP BY event_type UNION ALL
SELECT event_type, 'count', CAST(count(value) AS DOUBLE) FROM gappy GROUP BY event_type UNION ALL
SELECT event_type, 'min', min(value) FROM gappy GROUP BY event_type UNION ALL
SELECT event_type, 'max', max(value) FROM gappy GROUP BY event_type""")
def _(spark, sf):
    source = gappy(spark, sf)
    out = None
    for fn in ("mean", "sum", "count", "min", "max"):
        part = agg.aggregate(source, "event_type", "value", fn).select("event_type", F.lit(fn).alias("fn"), rounded("value", 6))
        out = part if out is None else out.unionByName(part)
    return out


@query("agg_02_resample_week", """
SELECT event_type, CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, round(avg(value), 6) AS value, round(avg(user_id), 6) AS user_id,
       round(avg(event_id), 6) AS event_id
FROM events GROUP BY 1, 2""")
def _(spark, sf):
    weekly = agg.resample(table(spark, sf, "events"), "ts", "W", "mean", None, ["event_type"])
    return weekly.select("event_type", "ts", rounded("value", 6), rounded("user_id", 6), rounded("event_id", 6))


@query("agg_02_resample_15min", """
SELECT CAST(time_bucket(INTERVAL '15 minutes', ts) AS TIMESTAMP) AS ts, round(sum(value), 6) AS value FROM events GROUP BY 1""")
def _(spark, sf):
    return agg.resample(table(spark, sf, "events"), "ts", "15min", "sum", "value").select("ts", rounded("value", 6))


@query("agg_02_resample_last", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, arg_max(value, ts) AS value FROM events GROUP BY 1""")
def _(spark, sf):
    return agg.resample(table(spark, sf, "events"), "ts", "H", "last", "value", tiebreak="event_id")


@query("agg_02_resample_quarter", """
SELECT CAST(make_date(CAST(year(o_orderdate) AS INT), CAST((month(o_orderdate) - 1) // 2 * 2 + 1 AS INT), 1) AS TIMESTAMP) AS o_orderdate,
       max(o_totalprice) AS o_totalprice
FROM orders GROUP BY 1""")
def _(spark, sf):
    return agg.resample(table(spark, sf, "orders"), "o_orderdate", "2M", "max", "o_totalprice")


@query("src_06_pre_aggregate", """
SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS l_shipdate, l_returnflag,
       round(sum(l_quantity), 4) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice
FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2""")
def _(spark, sf):
    made = agg.pre_aggregate(
        table(spark, sf, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice"], ["l_returnflag"], "1M", "sum"
    )
    return made.select("l_shipdate", "l_returnflag", rounded("l_quantity"), rounded("l_extendedprice", 2))


# The mean of decimals with two digits, rounded half up at six digits in whole numbers.
DECIMAL_MEAN = "CAST((20000 * sum(CAST(round({c} * 100) AS HUGEINT)) + count({c})) // (2 * count({c})) AS DOUBLE) / 1000000 AS {c}"


@query("agg_03_dedup_mean", f"""
SELECT o_orderdate, {DECIMAL_MEAN.format(c="o_orderkey")}, {DECIMAL_MEAN.format(c="o_custkey")}, {DECIMAL_MEAN.format(c="o_totalprice")}
FROM orders GROUP BY o_orderdate""")
def _(spark, sf):
    # Decimals sum without rounding, so both sides agree on every digit.
    names = ("o_orderkey", "o_custkey", "o_totalprice")
    orders = table(spark, sf, "orders")
    made = agg.dedup_mean(orders.withColumns({c: F.col(c).cast("decimal(18,2)") for c in names}), "o_orderdate")
    return made.select("o_orderdate", *[F.col(c).cast("double").alias(c) for c in names])


@query("agg_04_panel_mean", """
SELECT o_orderdate, o_orderpriority, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    made = agg.panel_mean(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"])
    return made.select("o_orderdate", "o_orderpriority", rounded("value", 6))


@query("agg_05_panel_total", """
SELECT o_orderdate, round(sum(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1""")
def _(spark, sf):
    made = agg.panel_total(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return made.select("o_orderdate", rounded("o_totalprice"))


@query("agg_06_group_stats", """
WITH sizes AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS n_groups, min(n) AS min_group_size, max(n) AS max_group_size,
       count(*) FILTER (WHERE n < 30) AS small_groups, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_group_size
FROM sizes""")
def _(spark, sf):
    return agg.group_stats(table(spark, sf, "orders"), ["o_custkey"])


@query("agg_07_duplicate_count", """
SELECT 'all' AS scope, count(*) - count(DISTINCT o_orderdate) AS n_duplicates FROM orders
UNION ALL
SELECT 'per_priority', count(*) - count(DISTINCT (o_orderdate, o_orderpriority)) FROM orders""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    whole = agg.duplicate_count(orders, "o_orderdate").select(F.lit("all").alias("scope"), "n_duplicates")
    keyed = agg.duplicate_count(orders, "o_orderdate", ["o_orderpriority"])
    return whole.unionByName(keyed.select(F.lit("per_priority").alias("scope"), "n_duplicates"))


@query("agg_08_missing_summary", f"""WITH {GAPPY}
SELECT 'event_id' AS column_name, count(*) - count(event_id) AS missing, 0.0::DOUBLE AS missing_pct FROM gappy UNION ALL
SELECT 'ts', count(*) - count(ts), 0.0 FROM gappy UNION ALL
SELECT 'event_type', count(*) - count(event_type), 0.0 FROM gappy UNION ALL
SELECT 'user_id', count(*) - count(user_id), 0.0 FROM gappy UNION ALL
SELECT 'value', count(*) - count(value), round(100.0 * (count(*) - count(value)) / count(*), 2) FROM gappy""")
def _(spark, sf):
    return agg.missing_summary(gappy(spark, sf))


DESCRIBE = """SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS null_count,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
  round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS q50,
  round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM lineitem"""


@query("agg_09_describe", " UNION ALL ".join(DESCRIBE.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(spark, sf):
    made = agg.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    numbers = ("mean", "std", "min", "q25", "q50", "q75", "max")
    return made.select("column_name", "count", "null_count", *[rounded(c) for c in numbers])


PREVIEW = """SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM part"""


@query("agg_10_preview_stats", " UNION ALL ".join(PREVIEW.format(c=c) for c in ("p_partkey", "p_size", "p_retailprice")))
def _(spark, sf):
    return agg.preview_stats(table(spark, sf, "part"))


@query("agg_11_target_stats", f"""WITH {GAPPY}
SELECT event_type, count(value) AS count, count(*) - count(value) AS missing,
       round(100.0 * (count(*) - count(value)) / count(*), 2) AS missing_pct,
       round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
       round(100.0 * count(*) FILTER (WHERE value = 0) / count(value), 2) AS zeros_pct,
       round(100.0 * count(*) FILTER (WHERE value < 0) / count(value), 2) AS negative_pct
FROM gappy GROUP BY event_type""")
def _(spark, sf):
    return agg.target_stats(gappy(spark, sf), "value", ["event_type"])


@query("agg_11_target_stats_negative", """
SELECT count(c_acctbal) AS count, count(*) - count(c_acctbal) AS missing, 0.0::DOUBLE AS missing_pct,
       round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, round(min(c_acctbal), 4) AS min,
       round(max(c_acctbal), 4) AS max, round(100.0 * count(*) FILTER (WHERE c_acctbal = 0) / count(*), 2) AS zeros_pct,
       round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*), 2) AS negative_pct
FROM customer""")
def _(spark, sf):
    return agg.target_stats(table(spark, sf, "customer"), "c_acctbal")


IQR_SQL = f"""WITH {SPIKY}, {FENCES}
SELECT event_type, round(min(lower), 4) AS lower, round(min(upper), 4) AS upper,
       count(*) FILTER (WHERE value < lower OR value > upper) AS outliers,
       round(100.0 * count(*) FILTER (WHERE value < lower OR value > upper) / count(value), 2) AS outliers_pct
FROM spiky JOIN bounds USING (event_type) GROUP BY event_type"""


@query("agg_12_iqr_outliers", IQR_SQL)
def _(spark, sf):
    made = agg.iqr_outliers(spiky(spark, sf), "value", ["event_type"])
    return made.select("event_type", rounded("lower"), rounded("upper"), "outliers", "outliers_pct")


@query("agg_12_iqr_outliers_sorted", IQR_SQL)
def _(spark, sf):
    made = agg.iqr_outliers(spiky(spark, sf), "value", ["event_type"], strategy="banded")
    return made.select("event_type", rounded("lower"), rounded("upper"), "outliers", "outliers_pct")


@query("agg_12_quartiles_nearest", """
WITH ranked AS (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
         count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (WHERE i = CAST(round(0.25::DOUBLE * (n - 1)) AS BIGINT)) AS q1,
       max(value) FILTER (WHERE i = CAST(round(0.75::DOUBLE * (n - 1)) AS BIGINT)) AS q3
FROM ranked GROUP BY event_type""")
def _(spark, sf):
    from tidemark.operators.stats import quantiles

    return quantiles(
        table(spark, sf, "events"), "value", {"q1": 0.25, "q3": 0.75}, ["event_type"], "nearest", "banded"
    )


@query("agg_13_zscore_outliers", f"""WITH {SPIKY},
m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd FROM spiky GROUP BY 1)
SELECT event_type, count(*) FILTER (WHERE abs(value - mean) / sd > 3) AS outliers_count,
       round(100.0 * count(*) FILTER (WHERE abs(value - mean) / sd > 3) / count(value), 6) AS outliers_pct
FROM spiky JOIN m USING (event_type) GROUP BY 1""")
def _(spark, sf):
    made = agg.zscore_outliers(spiky(spark, sf), "value", ["event_type"])
    return made.select("event_type", "outliers_count", rounded("outliers_pct", 6))


@query("agg_14_skewness", """
WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1)
SELECT event_type, round(avg((value - mean) ** 3) / (avg((value - mean) ** 2) ** 1.5), 4) AS skewness
FROM events JOIN m USING (event_type) GROUP BY 1""")
def _(spark, sf):
    return agg.skewness(table(spark, sf, "events"), "value", ["event_type"])


@query("agg_15_value_counts", """
SELECT l_shipdate, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, l_shipdate LIMIT 20""")
def _(spark, sf):
    return agg.value_counts(table(spark, sf, "lineitem"), "l_shipdate")


CORR = """SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"""
NUMERICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("agg_16_correlation_matrix", " UNION ALL ".join(CORR.format(a=a, b=b) for a in NUMERICS for b in NUMERICS))
def _(spark, sf):
    made = agg.correlation_matrix(table(spark, sf, "lineitem"), NUMERICS)
    return made.select("column_a", "column_b", rounded("corr", 6))


@query("agg_16_correlation_target", " UNION ALL ".join(
    f"SELECT '{b}' AS column_name, round(abs(corr(l_extendedprice, {b})), 6) AS abs_corr FROM lineitem"
    for b in ("l_quantity", "l_discount", "l_tax")))
def _(spark, sf):
    made = agg.correlation_with(table(spark, sf, "lineitem"), "l_extendedprice", NUMERICS)
    return made.select("column_name", rounded("abs_corr", 6))


@query("agg_17_date_range", """
SELECT event_type, CAST(min(ts) AS DATE) AS start_date, CAST(max(ts) AS DATE) AS end_date FROM events GROUP BY 1""")
def _(spark, sf):
    return agg.date_range(table(spark, sf, "events"), "ts", ["event_type"])


@query("agg_18_data_age", """
SELECT event_type, CAST(floor(epoch(TIMESTAMP '2024-03-01 00:00:00' - max(ts)) / 86400) AS INTEGER) AS data_age_days,
       CAST(max(ts) AS DATE) AS last_data_date
FROM events GROUP BY 1""")
def _(spark, sf):
    as_of = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    return agg.data_age(table(spark, sf, "events"), "ts", as_of, ["event_type"])


# -- joins and sets ---------------------------------------------------------------------------


def _ship_days(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("shipped"), F.sum("l_quantity").alias("quantity")
    )


SHIP = """ship AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS shipped, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)"""


@query("joi_01_join_external", f"""WITH {SHIP}
SELECT o.o_orderkey, o.o_totalprice, s.shipped, round(s.quantity, 4) AS quantity
FROM orders o LEFT JOIN ship s ON CAST(o.o_orderdate AS DATE) = s.date""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    made = joins.join_external(orders, _ship_days(spark, sf), "o_orderdate", "date")
    return made.select("o_orderkey", "o_totalprice", "shipped", rounded("quantity"))


OVERLAP = """SELECT count(DISTINCT a.d) AS n_dates, count(DISTINCT b.d) AS n_common,
  round(100.0 * count(DISTINCT b.d) / count(DISTINCT a.d), 1) AS overlap_pct,
  100.0 * count(DISTINCT b.d) / count(DISTINCT a.d) >= 10 AS accepted
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) a
LEFT JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) b ON a.d = b.d"""


@query("joi_02_date_overlap", OVERLAP)
def _(spark, sf):
    return joins.date_overlap(table(spark, sf, "orders"), "o_orderdate", table(spark, sf, "lineitem"), "l_shipdate")


def _month_starts(spark, sf):
    return table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("holiday_date")).distinct()


@query("joi_03_holiday_flag", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN CAST(l_shipdate AS DATE) IN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders) THEN 1 ELSE 0 END AS is_holiday
FROM lineitem""")
def _(spark, sf):
    made = joins.holiday_flag(table(spark, sf, "lineitem"), "l_shipdate", _month_starts(spark, sf))
    return made.select("l_orderkey", "l_linenumber", "is_holiday")


@query("joi_04_rank_joins", """
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
ships AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
evs AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events),
pct AS (
  SELECT 'lineitem' AS table_name, 10 AS n_features, 100.0 * count(s.d) / count(*) AS p FROM days LEFT JOIN ships s USING (d)
  UNION ALL
  SELECT 'events', 5, 100.0 * count(e.d) / count(*) FROM days LEFT JOIN evs e USING (d))
SELECT table_name, n_features, round(p, 1) AS overlap_pct,
       round(CASE WHEN round(p, 1) > 80 THEN least(least(round(p, 1) / 100, 0.95) + 0.1, 0.98) ELSE least(round(p, 1) / 100, 0.95) END, 4)::DOUBLE AS confidence
FROM pct WHERE p >= 10""")
def _(spark, sf):
    tables = {
        "lineitem": (table(spark, sf, "lineitem"), "l_shipdate"),
        "events": (table(spark, sf, "events"), "ts"),
    }
    made = joins.rank_joins(table(spark, sf, "orders"), "o_orderdate", tables, has_seasonality=True)
    return made.select("table_name", "n_features", "overlap_pct", rounded("confidence"))


@query("joi_05_join_future_exog", """
WITH last AS (SELECT o_orderpriority AS series, max(CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)) AS d FROM orders GROUP BY 1),
grid AS (SELECT series, CAST(h AS INTEGER) AS step, d + to_days(CAST(h AS INTEGER)) AS ds FROM last, range(1, 91) r(h)),
exog AS (SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ds, avg(l_discount) AS discount FROM lineitem GROUP BY 1)
SELECT series, step, g.ds, round(discount, 6) AS discount FROM grid g LEFT JOIN exog e ON g.ds = e.ds""")
def _(spark, sf):
    from tidemark.models.grid import future_grid

    days = order_panel(spark, sf)
    last = days.groupBy("series").agg(F.max("ds").alias("last"))
    grid = future_grid(last, "last", 90, "D", ["series"])
    exog = agg.resample(table(spark, sf, "lineitem"), "l_shipdate", "D", "mean", "l_discount").select(
        F.col("l_shipdate").alias("ds"), F.col("l_discount").alias("discount")
    )
    made = joins.join_future_exog(grid, exog, "ds", [], ["discount"])
    return made.select("series", "step", "ds", rounded("discount", 6))


@query("set_01_common_dates", """
SELECT CAST(o_orderdate AS DATE) AS date FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem""")
def _(spark, sf):
    return joins.common_dates(table(spark, sf, "orders"), "o_orderdate", table(spark, sf, "lineitem"), "l_shipdate")


@query("set_02_distinct_dates", "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events")
def _(spark, sf):
    return joins.distinct_dates(table(spark, sf, "events"), "ts")


# -- scalar functions ---------------------------------------------------------------------------


@query("scl_01_day_of_week", """
SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS day_of_week FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", date_part(F.col("o_orderdate"), "dayofweek").alias("day_of_week"))


PARTS = {"month": "month", "day_of_month": "day", "quarter": "quarter", "year": "year", "day_of_year": "dayofyear", "week_of_year": "week"}


@query("scl_02_date_parts", "SELECT o_orderkey, " + ", ".join(f"CAST({f}(o_orderdate) AS INTEGER) AS {n}" for n, f in PARTS.items()) + " FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", *[date_part(F.col("o_orderdate"), p).alias(p) for p in PARTS])


@query("scl_03_is_weekend", """
SELECT o_orderkey, CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", date_part(F.col("o_orderdate"), "is_weekend").alias("is_weekend"))


@query("scl_04_time_parts", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(second(ts) AS INTEGER) AS second FROM events""")
def _(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", *[date_part(F.col("ts"), p).alias(p) for p in ("hour", "minute", "second")])


@query("scl_05_future_dates", """
WITH last AS (SELECT event_type, max(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS d FROM events GROUP BY 1)
SELECT event_type, 'D' AS frequency, CAST(h AS INTEGER) AS step, d + to_days(CAST(h AS INTEGER)) AS ds FROM last, range(1, 15) r(h)
UNION ALL
SELECT event_type, 'MS', CAST(h AS INTEGER), CAST(date_trunc('month', d) + to_months(CAST(h AS INTEGER)) AS TIMESTAMP) FROM last, range(1, 15) r(h)
UNION ALL
SELECT event_type, '15min', CAST(h AS INTEGER), d + to_minutes(15 * h) FROM last, range(1, 15) r(h)""")
def _(spark, sf):
    from tidemark.models.grid import future_grid

    events = table(spark, sf, "events")
    last = events.groupBy("event_type").agg(F.max(F.date_trunc("day", "ts")).cast("timestamp_ntz").alias("last"))
    out = None
    for code in ("D", "MS", "15min"):
        part = future_grid(last, "last", 14, code, ["event_type"]).withColumn("frequency", F.lit(code))
        out = part if out is None else out.unionByName(part)
    return out.select("event_type", "frequency", "step", "ds")


@query("scl_05_shift_periods", """
SELECT event_id, CAST(ts + to_weeks(2) AS TIMESTAMP) AS later,
       CAST(date_trunc('month', ts) + to_months(2) + (ts - date_trunc('day', ts)) AS TIMESTAMP) AS month_later
FROM events""")
def _(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", shift_periods(ts, F.lit(2), "W").alias("later"), shift_periods(ts, F.lit(2), "MS").alias("month_later")
    )


@query("scl_06_non_strict_cast", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS number,
       TRY_CAST(CASE WHEN event_id % 13 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS day, CAST(user_id AS VARCHAR) AS label
FROM events""")
def _(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("number"),
        F.when(F.col("event_id") % 13 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.col("user_id").alias("label"),
    )
    return prj.cast_types(text, {"number": "bigint", "day": "date", "label": "string"})


@query("scl_07_text", """
SELECT event_type, count(*) AS n, lower('TS_' || event_type) AS label,
       regexp_matches(lower(event_type), 'click|view') AS looks FROM events GROUP BY event_type""")
def _(spark, sf):
    counted = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    label = F.lower(F.concat(F.lit("TS_"), F.col("event_type")))
    return counted.select("event_type", "n", label.alias("label"), F.lower("event_type").rlike("click|view").alias("looks"))


@query("scl_09_math", """
SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS root, round(power(l_discount, 2), 6) AS squared,
       CAST(sign(l_quantity - 25) AS DOUBLE) AS side, abs(l_quantity - 25) AS distance FROM lineitem""")
def _(spark, sf):
    away = F.col("l_quantity") - 25
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.round(F.pow("l_discount", F.lit(2)), 6).alias("squared"), F.signum(away).alias("side"), F.abs(away).alias("distance"),
    )


@query("scl_12_non_null_count", f"""WITH {GAPPY}
SELECT event_id, CAST((value IS NOT NULL)::INT + (user_id IS NOT NULL)::INT AS INTEGER) AS filled FROM gappy""")
def _(spark, sf):
    return gappy(spark, sf).select("event_id", prj.non_null_count(["value", "user_id"]).alias("filled"))


@query("scl_13_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@query("scl_14_arrays", """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, CAST(embedding[i] AS DOUBLE) AS value
FROM embeddings, range(1, 51) r(i) WHERE i <= len(embedding)""")
def _(spark, sf):
    sliced = F.slice("embedding", 1, 50)
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size(sliced) - 1).alias("position"), sliced.alias("value"))
    return table(spark, sf, "embeddings").select("vec_id", F.inline(zipped).alias("position", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


@query("scl_15_maps", """
SELECT event_type, 'columns' AS part, count(*) AS n FROM events WHERE NOT starts_with(event_type, 'p') GROUP BY 1""")
def _(spark, sf):
    from tidemark.sources.catalog import user_columns

    counted = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    marked = F.when(F.col("event_type").startswith("p"), F.concat(F.lit("__"), F.col("event_type"))).otherwise(F.col("event_type"))
    schema = F.create_map(marked, F.col("n"), F.lit("__meta"), F.lit(0).cast("long"))
    kept = counted.select(F.explode(user_columns(schema)).alias("event_type", "n"))
    return kept.select("event_type", F.lit("columns").alias("part"), "n")


@query("scl_16_improvement_and_bands", """
WITH u AS (SELECT user_id, avg(value) AS mean FROM events GROUP BY 1), g AS (SELECT avg(value) AS base FROM events)
SELECT user_id, round((base - mean) / base * 100, 4) AS improvement,
       CASE WHEN mean >= 85 THEN 'EXCELLENT' WHEN mean >= 70 THEN 'GOOD' WHEN mean >= 50 THEN 'FAIR' ELSE 'POOR' END AS band
FROM u, g""")
def _(spark, sf):
    from tidemark.diagnostics.health import health_band
    from tidemark.models.evaluate import improvement_pct

    events = table(spark, sf, "events")
    base = events.agg(F.avg("value").alias("base")).scalar()
    users = events.groupBy("user_id").agg(F.avg("value").alias("mean")).withColumn("base", base)
    return users.select(
        "user_id",
        F.round(improvement_pct(F.col("mean"), F.col("base")), 4).alias("improvement"),
        health_band(F.col("mean")).alias("band"),
    )
