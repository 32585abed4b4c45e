"""Dataset catalog: append-only rows, newest row per dataset wins."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.join import latest_by

# Prefix of keys in a schema map that are not columns.
META_PREFIX = "__"

DATASET_SCHEMA = (
    "id string, tenant_id string, name string, path string, file_type string, schema_json map<string,string>, "
    "row_count bigint, column_count int, datetime_column string, target_column string, dataset_type string, "
    "linked_id string, status string, last_error string, updated_at timestamp"
)


def schema_map(df: DataFrame, meta: Mapping[str, str] | None = None) -> dict[str, str]:
    """Column -> type text, with metadata under prefixed keys."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return {**types, **{f"{META_PREFIX}{k}": v for k, v in (meta or {}).items()}}


def user_columns(schema: Column) -> Column:
    return F.map_filter(schema, lambda k, _: ~k.startswith(META_PREFIX))


def catalog_row(
    df: DataFrame,
    dataset_id: str,
    tenant_id: str,
    name: str,
    path: str,
    updated_at: datetime,
    file_type: str = "parquet",
    datetime_column: str | None = None,
    target_column: str | None = None,
    dataset_type: str = "main",
    linked_id: str | None = None,
    status: str = "connected",
    last_error: str | None = None,
    row_count: int | None = None,
) -> DataFrame:
    """One catalog row; the count is the only job, and none when it is given."""
    count = df.count() if row_count is None else row_count
    meta = {"type": dataset_type, **({"linked": linked_id} if linked_id else {})}
    values = (
        dataset_id, tenant_id, name, path, file_type, schema_map(df, meta), count, len(df.columns),
        datetime_column, target_column, dataset_type, linked_id, status, last_error, updated_at,
    )
    return df.sparkSession.createDataFrame([values], DATASET_SCHEMA)


def register_dataset(row: DataFrame, catalog_path: str) -> None:
    row.write.mode("append").parquet(catalog_path)


def datasets(spark: SparkSession, catalog_path: str) -> DataFrame:
    """Current state: the newest row of every dataset."""
    return latest_by(spark.read.schema(DATASET_SCHEMA).parquet(catalog_path), ["id"], "updated_at", "status")
