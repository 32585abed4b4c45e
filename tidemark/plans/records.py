"""Queries: sources, sinks, catalog, runs, monitoring and audit tables.

The bookkeeping tables are derived from the given ones with fixed rules, so that they
grow with them.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import join as joins
from tidemark.operators import monitor as mon
from tidemark.plans.registry import query, rounded, table
from tidemark.session import fresh_path
from tidemark.sources import catalog, files, sinks
from tidemark.sources.jdbc import JdbcSource, list_tables, shape

# -- files ------------------------------------------------------------------------------------


@query("src_01_load_time_series", """
SELECT CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS stamp, value FROM events""")
def _(spark, sf):
    stamp = F.when(F.col("event_id") % 13 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    text = table(spark, sf, "events").select(stamp.alias("stamp"), "value", "event_type")
    path = sinks.round_trip(text, "csv", "series")
    return files.load_time_series(spark, path, "stamp", "value", "stamp string, value double, event_type string")


@query("src_02_load_full", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    path = sinks.round_trip(orders, "csv", "orders")
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string"
    return files.load_full_dataframe(spark, path, "o_orderdate", schema)


@query("src_03_read_table", """
SELECT s_suppkey, s_acctbal, s_nationkey, 'csv' AS fmt FROM supplier UNION ALL SELECT s_suppkey, s_acctbal, s_nationkey, 'parquet' FROM supplier""")
def _(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    as_csv = files.read_table(spark, sinks.round_trip(supplier, "csv", "supplier"))
    as_parquet = files.read_table(spark, sinks.round_trip(supplier, "parquet", "supplier"))
    types = [F.col(f.name).cast(f.dataType).alias(f.name) for f in supplier.schema.fields]
    return as_csv.select(*types, F.lit("csv").alias("fmt")).union(as_parquet.select(*types, F.lit("parquet").alias("fmt")))


NAMES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query("src_09_discover_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in NAMES))
def _(spark, sf):
    found = files.discover_tables(spark, sf)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in found.items()]
    return reduce(DataFrame.unionByName, counts)


@query("src_04_source_shape", """
SELECT * FROM (SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS o_orderdate, o_orderpriority, round(sum(o_totalprice), 4) AS o_totalprice
FROM orders GROUP BY 1, 2)""")
def _(spark, sf):
    # The database itself is not needed to check what an import does with its rows.
    roll_up = {
        "datetime_column": "o_orderdate", "target_columns": ["o_totalprice"],
        "group_columns": ["o_orderpriority"], "frequency": "W", "aggregation": "sum",
    }
    source = JdbcSource("jdbc:unused", "orders", pre_aggregate=roll_up)
    return shape(table(spark, sf, "orders"), source).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("src_07_list_tables", """
SELECT DISTINCT 'shop.' || o_orderpriority AS "table" FROM orders WHERE o_orderstatus = 'F'""")
def _(spark, sf):
    listing = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "pg_catalog").otherwise("shop").alias("table_schema"),
        F.col("o_orderpriority").alias("table_name"),
        F.when(F.col("o_orderstatus") == "P", "VIEW").otherwise("BASE TABLE").alias("table_type"),
    ).distinct()
    return list_tables(listing)


@query("snk_01_write_snapshot", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = fresh_path(spark, "snapshot")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    sinks.write_snapshot(customer.limit(1), path)
    sinks.write_snapshot(customer, path)
    return files.read_table(spark, path, fmt="parquet")


@query("snk_02_sync_snapshot", """
SELECT id, status, row_count, column_count FROM (
  SELECT 'orders' AS id, 'connected' AS status, count(*) AS row_count, 6 AS column_count FROM orders
  UNION ALL SELECT 'broken', 'error', 0, 1)""")
def _(spark, sf):
    base, cat = fresh_path(spark, "data"), fresh_path(spark, "catalog")
    orders = lambda: table(spark, sf, "orders")
    few = lambda: orders().where("o_orderstatus = 'F'")
    broken = lambda: spark.read.parquet(fresh_path(spark, "missing"))
    first, second = datetime(2024, 1, 1), datetime(2024, 1, 2)
    sinks.sync_snapshot(spark, few, f"{base}/orders", cat, "orders", "t0", "orders", first)
    sinks.sync_snapshot(spark, orders, f"{base}/orders", cat, "orders", "t0", "orders", second)
    sinks.sync_snapshot(spark, broken, f"{base}/broken", cat, "broken", "t0", "broken", first)
    return catalog.datasets(spark, cat).select("id", "status", "row_count", "column_count")


def _decisions(spark, sf) -> DataFrame:
    """One audit record per event: the user's day is the trace, props the parameters."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("agent_name"),
        F.lit("data").alias("decision_type"),
        F.col("event_type").alias("action"),
        F.to_json(F.struct(F.col("value").alias("value"), F.col("event_type").alias("kind"))).alias("parameters"),
        F.lit(0.9).alias("confidence"),
        F.lit(None).cast("string").alias("reasoning"),
        (F.col("value") > 400).alias("requires_confirmation"),
        F.lit(0.5).alias("estimated_compute_seconds"),
        F.lit(50).alias("estimated_memory_mb"),
        F.col("value").alias("duration_ms"),
        F.lit(5).alias("memory_consumed_mb"),
        F.lit(512).alias("memory_budget_mb"),
        F.lit(0.1).alias("compute_consumed_s"),
        F.lit(300.0).alias("compute_budget_s"),
        (F.col("value") * 0.0000115741).alias("cost_usd"),
        F.lit("analysis").alias("phase"),
    )


TRACE = "user_id || '-' || strftime(ts, '%Y-%m-%d')"


@query("snk_03_append_decisions", f"""
SELECT {TRACE} AS trace_id, event_type AS action, value AS duration_ms, value > 400 AS requires_confirmation,
       value AS parameter_value FROM events""")
def _(spark, sf):
    path = fresh_path(spark, "decisions")
    made = _decisions(spark, sf)
    sinks.append_decisions(made.where("action = 'error'"), path)
    sinks.append_decisions(made.where("action <> 'error'"), path)
    back = sinks.read_decisions(spark, path)
    parameter = F.from_json("parameters", "value double")["value"].alias("parameter_value")
    return back.select("trace_id", "action", "duration_ms", "requires_confirmation", parameter)


@query("agg_19_cost_summary", f"""
SELECT {TRACE} AS trace_id, round(sum(value * 0.0000115741::DOUBLE), 6) AS total_cost_usd, round(sum(value) / 1000.0::DOUBLE, 2) AS total_compute_seconds,
       count(*) AS n_decisions FROM events GROUP BY 1""")
def _(spark, sf):
    # The offset keeps sums that end on an exact half from being rounded either way.
    made = _decisions(spark, sf)
    return mon.cost_summary(made)


@query("agg_20_trace_metrics", f"""
WITH s AS (SELECT {TRACE} AS trace_id, event_type, value <= 480 AS ok FROM events),
t AS (SELECT trace_id, count(*) AS n, bool_and(ok) AS ok, count(*) FILTER (WHERE event_type = 'click') AS tools,
        count(*) FILTER (WHERE event_type = 'click' AND ok) AS tools_ok FROM s GROUP BY 1)
SELECT count(*) AS total_traces, round(count(*) FILTER (WHERE ok) / count(*), 6) AS success_rate, round(sum(n) / count(*), 6)::DOUBLE AS avg_steps_per_trace,
       round(sum(tools_ok) / sum(tools), 6)::DOUBLE AS tool_success_rate FROM t""")
def _(spark, sf):
    steps = _decisions(spark, sf).select(
        "trace_id", F.when(F.col("action") == "click", "tool").otherwise("step").alias("step_type"),
        (F.col("duration_ms") <= 480).alias("success"),
    )
    made = mon.trace_metrics(steps)
    return made.select("total_traces", *[rounded(c, 6) for c in ("success_rate", "avg_steps_per_trace", "tool_success_rate")])


@query("srt_07_recent_decisions", f"""
SELECT {TRACE} AS trace_id, ts AS at, value AS duration_ms FROM events ORDER BY ts DESC LIMIT 50""")
def _(spark, sf):
    made = mon.recent_decisions(_decisions(spark, sf))
    return made.select("trace_id", F.col("timestamp").cast("timestamp_ntz").alias("at"), "duration_ms")


# -- runs, versions, forecasts ----------------------------------------------------------------


def _datasets(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("target_column"),
    )


@query("joi_06_catalog_join", """
WITH s AS (SELECT o_custkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS target_column,
       o_orderpriority AS source_type, o_orderstatus AS source_status
FROM customer LEFT JOIN s ON o_custkey = c_custkey AND i = 1""")
def _(spark, sf):
    sources = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("dataset_id"), F.col("o_orderpriority").alias("source_type"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"),
    )
    return joins.catalog_join(_datasets(spark, sf), sources)


def _runs(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("dataset_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("target_column"),
    )


@query("joi_07_run_dataset_join", """
SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS dataset_id, c_name AS dataset_name,
       coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END) AS target_column
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf):
    return joins.run_dataset_join(_runs(spark, sf), _datasets(spark, sf), {"target_column": "target_column"})


@query("snk_06_register_dataset", """
SELECT id, datetime_column, row_count, column_count, dataset_type, columns FROM (
  SELECT 'events' AS id, 'ts' AS datetime_column, count(*) AS row_count, 6 AS column_count, 'main' AS dataset_type, 'event_id,event_type,props,ts,user_id,value' AS columns FROM events
  UNION ALL SELECT 'orders', 'o_orderdate', count(*), 6, 'future_variables', 'o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice' FROM orders)""")
def _(spark, sf):
    from tidemark.operators.profile import detect_datetime

    path = fresh_path(spark, "catalog")
    for day, name, kind in ((1, "events", "main"), (2, "orders", "main"), (3, "orders", "future_variables")):
        df = table(spark, sf, name)
        row = catalog.catalog_row(
            df, name, "t0", name, f"{sf}/{name}.parquet", datetime(2024, 1, day),
            datetime_column=detect_datetime(df), dataset_type=kind,
        )
        catalog.register_dataset(row, path)
    columns = F.concat_ws(",", F.array_sort(F.map_keys(catalog.user_columns(F.col("schema_json"))))).alias("columns")
    return catalog.datasets(spark, path).select("id", "datetime_column", "row_count", "column_count", "dataset_type", columns)


@query("snk_07_log_step", """
SELECT CAST(o_orderkey AS VARCHAR) AS model_run_id, 'training' AS step_name, CAST(o_custkey AS DOUBLE) AS duration_seconds,
       CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'done' END AS status
FROM orders""")
def _(spark, sf):
    path = fresh_path(spark, "steps")
    orders = table(spark, sf, "orders")
    base = [F.col("o_orderkey").cast("string").alias("model_run_id"), F.lit("training").alias("step_name")]
    started = orders.select(*base, F.lit("running").alias("status"), F.lit("").alias("message"), F.col("o_orderdate").alias("created_at"))
    later = F.timestamp_add("SECOND", F.col("o_custkey"), F.col("o_orderdate"))
    done = orders.select(*base, F.lit("done").alias("status"), F.lit("").alias("message"), later.alias("created_at"))
    failed = orders.where("o_orderstatus = 'P'").select(
        *base, F.lit("failed").alias("status"), F.lit("").alias("message"), F.timestamp_add("SECOND", F.lit(1), later).alias("created_at")
    )
    for part in (started, done, failed):
        sinks.log_step(part, path)
    return sinks.step_durations(spark.read.parquet(path)).select("model_run_id", "step_name", "duration_seconds", "status")


def _versions(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tenant_id"),
        (F.col("o_orderkey") % 1000).cast("int").alias("version"), F.lit(True).alias("is_active"),
    )


@query("agg_23_next_version", """
SELECT c_custkey AS tenant_id, CAST(coalesce(max(o_orderkey % 1000), 0) + 1 AS INTEGER) AS next_version
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    tenants = table(spark, sf, "customer").select(F.col("c_custkey").alias("tenant_id"))
    return mon.next_version(_versions(spark, sf), tenants)


@query("agg_23_promote", """
SELECT o_orderkey AS id, o_custkey AS tenant_id, CAST(o_orderkey % 1000 AS INTEGER) AS version,
       o_orderkey % 1000 = max(o_orderkey % 1000) OVER (PARTITION BY o_custkey) AS is_active FROM orders""")
def _(spark, sf):
    return mon.promote(_versions(spark, sf))


@query("srt_04_latest_forecast", """
SELECT o_orderkey AS id, o_custkey AS model_run_id, o_orderdate AS created_at, o_totalprice AS prediction FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, sf):
    forecasts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("model_run_id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("prediction"),
    )
    return mon.latest_forecast(forecasts)


# -- monitoring ---------------------------------------------------------------------------------


def _logs(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("tenant_id"), F.col("user_id").alias("model_version_id"),
        F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), F.lit(400.0).alias("threshold"),
        (F.col("value") > 400).alias("alert_triggered"), F.col("ts").alias("created_at"),
    )


def _as_of(spark, sf):
    return table(spark, sf, "events").agg(F.max("ts").alias("t")).scalar()


@query("agg_21_monitoring_summary", """
WITH t AS (SELECT max(ts) AS t FROM events),
a AS (SELECT user_id % 3 AS tenant_id, count(*) AS n FROM events, t WHERE value > 400 AND ts >= t - INTERVAL 24 HOURS GROUP BY 1),
v AS (SELECT user_id % 3 AS tenant_id, count(DISTINCT user_id) AS n, count(DISTINCT CASE WHEN user_id % 2 = 0 THEN user_id END) AS active FROM events GROUP BY 1),
s AS (SELECT c_custkey % 3 AS tenant_id, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS active FROM customer GROUP BY 1)
SELECT v.tenant_id, v.n AS total_versions, v.active AS active_versions, s.n AS total_schedules, s.active AS active_schedules, coalesce(a.n, 0) AS alerts_24h
FROM v JOIN s USING (tenant_id) LEFT JOIN a USING (tenant_id)""")
def _(spark, sf):
    versions = table(spark, sf, "events").select("user_id").distinct().select(
        (F.col("user_id") % 3).alias("tenant_id"), (F.col("user_id") % 2 == 0).alias("is_active")
    )
    schedules = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 3).alias("tenant_id"), (F.col("c_acctbal") > 0).alias("is_active")
    )
    return mon.monitoring_summary(versions, _logs(spark, sf), schedules, _as_of(spark, sf))


@query("agg_21_recent_metrics", """
SELECT ts AS created_at, event_type AS metric_name, value AS metric_value, 400.0::DOUBLE AS threshold, value > 400 AS alert_triggered
FROM events WHERE user_id % 3 = 1 ORDER BY ts DESC, event_id LIMIT 10""")
def _(spark, sf):
    return mon.recent_metrics(_logs(spark, sf), 1)


@query("agg_22_paged_count", """
SELECT event_id AS id, ts AS created_at, count(*) OVER () AS total FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50""")
def _(spark, sf):
    made = mon.paged_count(_logs(spark, sf), {"metric_name": "click", "tenant_id": None}, "created_at", 25, 50, ["id"])
    return made.select("id", "created_at", "total")


@query("srt_08_alerts", """
SELECT event_id AS id, event_type AS metric_name, value AS metric_value, ts AS created_at FROM events
WHERE value > 400 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 72 HOURS ORDER BY ts DESC, event_id LIMIT 50""")
def _(spark, sf):
    made = mon.alerts(_logs(spark, sf), _as_of(spark, sf), 72)
    return made.select("id", "metric_name", "metric_value", "created_at")


@query("srt_09_metric_history", """
SELECT event_id AS id, user_id AS model_version_id, ts AS created_at, value AS metric_value, bool_or(value > 400) OVER (PARTITION BY user_id) AS has_alerts
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")
def _(spark, sf):
    made = mon.metric_history(_logs(spark, sf), _as_of(spark, sf), 7)
    return made.select("id", "model_version_id", "created_at", "metric_value", "has_alerts")
