"""Snapshots, append-only record tables, forecasts and fitted coefficients."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.session import fresh_path
from tidemark.sources.catalog import catalog_row, register_dataset

DECISION_SCHEMA = (
    "trace_id string, user_id string, timestamp timestamp, agent_name string, decision_type string, action string, "
    "parameters string, confidence double, reasoning string, requires_confirmation boolean, "
    "estimated_compute_seconds double, estimated_memory_mb int, duration_ms double, memory_consumed_mb int, "
    "memory_budget_mb int, compute_consumed_s double, compute_budget_s double, cost_usd double, phase string"
)

STEP_SCHEMA = (
    "model_run_id string, step_name string, status string, message string, created_at timestamp"
)


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a dataset. The path must not be one that ``df`` reads from."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown snapshot format {fmt!r}")
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def sync_snapshot(
    spark: SparkSession,
    fetch: Callable[[], DataFrame],
    base_path: str,
    catalog_path: str,
    dataset_id: str,
    tenant_id: str,
    name: str,
    at: datetime,
) -> str | None:
    """Read a source again into a new versioned path and append its catalog row.

    Readers keep the old version until the new row is there; a failed read leaves the
    data alone and is recorded with its error. Rows are counted by the write itself.
    """
    path = f"{base_path.rstrip('/')}/v{at:%Y%m%d%H%M%S%f}"
    try:
        source = fetch()
        seen = Observation("sync")
        source.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
        row = catalog_row(source, dataset_id, tenant_id, name, path, at, row_count=seen.get["rows"])
    except Exception as error:
        empty = spark.createDataFrame([], "nothing string")
        row = catalog_row(
            empty, dataset_id, tenant_id, name, "", at, status="error", last_error=str(error)[:500], row_count=0
        )
        register_dataset(row, catalog_path)
        return None
    register_dataset(row, catalog_path)
    return path


def append_decisions(decisions: DataFrame, path: str, fmt: str = "json") -> None:
    """Append audit records as JSON lines or Parquet."""
    decisions.write.mode("append").format(fmt).save(path)


def read_decisions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(DECISION_SCHEMA).format(fmt).load(path)


def save_forecast(forecast: DataFrame, path: str, run_id: str) -> None:
    """Append the long forecast table of one run."""
    forecast.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def forecast_payload(forecast: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One JSON text per series with parallel dates and predictions; at most ``horizon`` entries."""
    by = [col(k) for k in keys or []]
    packed = forecast.groupBy(*by, "model_name").agg(
        F.array_sort(F.collect_list(F.struct("step", "ds", "prediction"))).alias("__p")
    )
    payload = F.to_json(
        F.struct(
            F.transform("__p", lambda p: p["ds"].cast("string")).alias("dates"),
            F.transform("__p", lambda p: p["prediction"]).alias("predictions"),
            F.col("model_name").alias("model_name"),
        )
    )
    return packed.select(*by, payload.alias("predictions_json"))


def read_payload(payloads: DataFrame, column: str = "predictions_json", keep: list[str] | None = None) -> DataFrame:
    """Forecast rows back from the parallel arrays."""
    schema = "dates array<string>, predictions array<double>, model_name string"
    kept = [col(k) for k in keep or []]
    parsed = payloads.select(*kept, F.from_json(col(column), schema).alias("p"))
    pairs = parsed.select(
        *kept, "p.model_name", F.posexplode(F.arrays_zip("p.dates", "p.predictions")).alias("i", "pair")
    )
    return pairs.select(
        *kept, "model_name", (F.col("i") + 1).alias("step"),
        F.col("pair.dates").cast("timestamp_ntz").alias("ds"), F.col("pair.predictions").alias("prediction"),
    )


def save_coefficients(fitted: DataFrame, path: str) -> None:
    """Closed-form and seasonal models are one row per series; Spark ML models save themselves."""
    fitted.write.mode("overwrite").parquet(path)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def log_step(steps: DataFrame, path: str) -> None:
    """Append step transitions of a run."""
    steps.write.mode("append").parquet(path)


def step_durations(steps: DataFrame) -> DataFrame:
    """Seconds from a step's first ``running`` to its last ``done``; null while it runs."""
    status, at = F.col("status"), F.col("created_at")
    grouped = steps.groupBy("model_run_id", "step_name").agg(
        F.min(F.when(status == "running", at)).alias("started_at"),
        F.max(F.when(status == "done", at)).alias("finished_at"),
        F.max_by(status, F.struct(at, status != "running")).alias("status"),
    )
    spent = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")) / 1e6
    return grouped.withColumn("duration_seconds", spent)


def round_trip(df: DataFrame, fmt: str, name: str) -> str:
    """Write to a new path of the shared folder and return it."""
    path = fresh_path(df.sparkSession, name) + (".csv" if fmt == "csv" else ".parquet")
    write_snapshot(df, path, fmt)
    return path
