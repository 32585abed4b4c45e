"""Reads over run, version, monitoring, schedule and decision tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import all_of, col
from tidemark.operators.join import latest_by
from tidemark.operators.keys import attach


def _matching(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """Rows equal to every filter that is not None."""
    wanted = [col(k) == F.lit(v) for k, v in (filters or {}).items() if v is not None]
    return df.where(all_of(wanted)) if wanted else df


def cost_summary(decisions: DataFrame, per_trace: bool = True, trace_id: str | None = None) -> DataFrame:
    rows = _matching(decisions, {"trace_id": trace_id})
    return rows.groupBy(*(["trace_id"] if per_trace else [])).agg(
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
        F.round(F.coalesce(F.sum("duration_ms"), F.lit(0.0)) / 1000.0, 2).alias("total_compute_seconds"),
        F.count(F.lit(1)).alias("n_decisions"),
    )


def trace_metrics(steps: DataFrame) -> DataFrame:
    """Success share of traces, steps per trace, success share of tool calls.

    ``steps`` has one row per step: ``trace_id, step_type, success``. A trace succeeds
    when all its steps do.
    """
    traces = steps.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.bool_and("success").alias("success"),
        F.count_if(F.col("step_type") == "tool").alias("n_tools"),
        F.count_if((F.col("step_type") == "tool") & F.col("success")).alias("n_tools_ok"),
    )
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    n = F.count(F.lit(1))
    return traces.agg(
        n.alias("total_traces"),
        share(F.count_if("success"), n).alias("success_rate"),
        share(F.sum("n_steps"), n).alias("avg_steps_per_trace"),
        share(F.sum("n_tools_ok"), F.sum("n_tools")).alias("tool_success_rate"),
    )


def monitoring_summary(
    versions: DataFrame, logs: DataFrame, schedules: DataFrame, as_of: Column, tenant_id: object = None
) -> DataFrame:
    """Counts per tenant (or for one): versions, alerts of the last day, schedules."""
    v = _matching(versions, {"tenant_id": tenant_id}).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_versions"), F.count_if("is_active").alias("active_versions")
    )
    s = _matching(schedules, {"tenant_id": tenant_id}).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_schedules"), F.count_if("is_active").alias("active_schedules")
    )
    since = as_of - F.expr("INTERVAL 24 HOURS")
    a = (
        _matching(logs, {"tenant_id": tenant_id})
        .where(F.col("alert_triggered") & (F.col("created_at") >= since))
        .groupBy("tenant_id").agg(F.count(F.lit(1)).alias("alerts_24h"))
    )
    counts = ["total_versions", "active_versions", "total_schedules", "active_schedules", "alerts_24h"]
    parts = [t.select("tenant_id", *[(F.col(c) if c in t.columns else F.lit(None).cast("long")).alias(c) for c in counts]) for t in (v, s, a)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("tenant_id")
    return merged.agg(*[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts])


def recent_metrics(logs: DataFrame, tenant_id: object = None, n: int = 10) -> DataFrame:
    rows = _matching(logs, {"tenant_id": tenant_id}).orderBy(F.col("created_at").desc(), "id").limit(n)
    return rows.select("created_at", "metric_name", "metric_value", "threshold", "alert_triggered")


def paged_count(df: DataFrame, filters: dict[str, object] | None, order_by: str, limit: int, offset: int = 0, tiebreak: Sequence[str] = ()) -> DataFrame:
    """One page, newest first, each row with the total of the filtered rows."""
    rows = _matching(df, filters)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    order = [col(order_by).desc(), *[col(t) for t in tiebreak]]
    page = rows.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))
    return attach(page, total, [], ["total"])


def next_version(versions: DataFrame, tenants: DataFrame) -> DataFrame:
    """Next free version number of every tenant, 1 for a new one."""
    top = versions.groupBy("tenant_id").agg(F.max("version").alias("__top"))
    joined = attach(tenants.select("tenant_id").distinct(), top, ["tenant_id"], ["__top"])
    return joined.select("tenant_id", (F.coalesce("__top", F.lit(0)) + 1).alias("next_version"))


def promote(versions: DataFrame) -> DataFrame:
    """Only the highest version of each tenant stays active."""
    top = versions.groupBy("tenant_id").agg(F.max("version").alias("__top"))
    marked = attach(versions, top, ["tenant_id"], ["__top"])
    return marked.withColumn("is_active", F.col("version") == F.col("__top")).drop("__top")


def latest_forecast(forecasts: DataFrame) -> DataFrame:
    return latest_by(forecasts, ["model_run_id"], "created_at", "id")


def recent_decisions(decisions: DataFrame, n: int = 50, trace_id: str | None = None) -> DataFrame:
    """The last ``n`` records, or all records of one trace."""
    if trace_id is not None:
        return decisions.where(F.col("trace_id") == trace_id)
    return decisions.orderBy(F.col("timestamp").desc(), "trace_id").limit(n)


def alerts(logs: DataFrame, as_of: Column, hours: int = 24, limit: int = 50, tenant_id: object = None) -> DataFrame:
    """Alerts of the trailing hours, newest first, ``limit`` of them."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    rows = _matching(logs, {"tenant_id": tenant_id}).where(F.col("alert_triggered") & (F.col("created_at") >= since))
    return rows.orderBy(F.col("created_at").desc(), "id").limit(max(0, limit))


def metric_history(logs: DataFrame, as_of: Column, days: int = 30, version_id: object = None) -> DataFrame:
    """Time-ordered metrics of the trailing days with ``has_alerts`` per version.

    The flag is an aggregate joined back, so a version with very many rows is no hot window.
    """
    since = as_of - F.make_dt_interval(days=F.lit(days))
    rows = _matching(logs, {"model_version_id": version_id}).where(F.col("created_at") >= since)
    flags = rows.groupBy("model_version_id").agg(F.bool_or("alert_triggered").alias("has_alerts"))
    return attach(rows, flags, ["model_version_id"], ["has_alerts"]).orderBy("created_at", "id")


