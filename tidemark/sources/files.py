"""File sources: format by suffix, typed series loading, folders of tables, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.functions.columns import col, require
from tidemark.operators.project import sort_rows

FORMATS = {".csv": "csv", ".parquet": "parquet"}

def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name[name.rfind("."):].lower() if "." in name else ""


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None
) -> DataFrame:
    """Read a file, folder or glob. A given schema saves the inference pass.

    Without a known suffix the footer decides: what opens as Parquet is Parquet, else CSV.
    """
    fmt = fmt or FORMATS.get(suffix(path)) or ("parquet" if _is_parquet(spark, path) else "csv")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true").option("timestampType", "TIMESTAMP_NTZ")
    return reader.load(path)


def _is_parquet(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except PySparkException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise
        return False


def load_full_dataframe(
    spark: SparkSession, path: str, datetime_column: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """All columns; with a datetime column, cast it non-strictly and sort by it."""
    df = read_table(spark, path, schema)
    if datetime_column and datetime_column in df.columns:
        df = df.withColumn(datetime_column, col(datetime_column).try_cast("timestamp_ntz"))
        df = sort_rows(df, datetime_column)
    return df


def load_time_series(
    spark: SparkSession,
    path: str,
    date_column: str = "date",
    value_column: str = "value",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Time and ``value``, sorted by time; unreadable times become null."""
    df = read_table(spark, path, schema)
    require(df, date_column, value_column)
    series = df.select(
        col(date_column).try_cast("timestamp_ntz").alias(date_column), col(value_column).alias("value")
    )
    return sort_rows(series, date_column)


def discover_tables(spark: SparkSession, folder: str, skip_unreadable: bool = False) -> dict[str, DataFrame]:
    """Every CSV or Parquet entry of a folder on any Hadoop file system, by stem.

    An entry that cannot be read is an error unless ``skip_unreadable`` is set.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    found: dict[str, DataFrame] = {}
    for status in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
        name = status.getPath().getName()
        if suffix(name) not in FORMATS:
            continue
        try:
            found[name[: name.rfind(".")]] = read_table(spark, status.getPath().toString())
        except PySparkException:
            if not skip_unreadable:
                raise
    return found


def preview(df: DataFrame, limit: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` rows."""
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    return ordered.limit(max(0, int(limit)))
