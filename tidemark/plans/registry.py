"""Named queries over the given tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregate import resample

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- inputs derived from the tables, with the same expression in SQL -----------------------

GAPPY = """gappy AS (
  SELECT event_id, ts, event_type, user_id,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
  FROM events)"""


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select(
        "event_id", "ts", "event_type", "user_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


SPIKY = """spiky AS (
  SELECT event_id, ts, event_type,
         CASE WHEN event_id % 101 = 0 THEN value * 50 ELSE value END AS value
  FROM events)"""


def spiky(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    raised = F.when(F.col("event_id") % 101 == 0, F.col("value") * 50).otherwise(F.col("value"))
    return events.select("event_id", "ts", "event_type", raised.alias("value"))


# One row per event type and day: as many rows per series as the calendar has days.
PANEL = """panel AS (
  SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ds, sum(value) AS value
  FROM events GROUP BY ALL)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    daily = resample(table(spark, sf, "events"), "ts", "D", "sum", "value", ["event_type"])
    return daily.withColumnRenamed("ts", "ds")


# One row per order priority and day.
ORDER_PANEL = """order_panel AS (
  SELECT o_orderpriority AS series, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ds,
         sum(o_totalprice) AS value
  FROM orders GROUP BY ALL)"""


def order_panel(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "series")
    daily = resample(orders, "o_orderdate", "D", "sum", "o_totalprice", ["series"])
    return daily.select("series", F.col("o_orderdate").alias("ds"), F.col("o_totalprice").alias("value"))


def rounded(column: str | Column, digits: int = 4, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), digits).alias(name or column)
