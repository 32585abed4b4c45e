"""Joins with calendar and outside tables.

No broadcast is forced: Spark broadcasts a side only when its measured size allows,
and adaptive execution splits a skewed date otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import all_of, col, require

# Overlap below which a table is not offered, and the confidence rule.
MIN_OVERLAP_PCT = 10.0
MAX_CONFIDENCE = 0.95
SEASONAL_BONUS = 0.1
SEASONAL_MIN_OVERLAP = 80.0
SEASONAL_MAX_CONFIDENCE = 0.98


def as_date(column: str) -> Column:
    return col(column).try_cast("date")


def join_external(
    df: DataFrame,
    external: DataFrame,
    datetime_column: str,
    external_date_column: str,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Left join on the calendar date; keeps the outside columns, drops the join key."""
    names = list(features or [c for c in external.columns if c != external_date_column])
    require(external, external_date_column, *names)
    right = external.select(as_date(external_date_column).alias("__join_date"), *[col(c) for c in names])
    left = df.withColumn("__date", as_date(datetime_column))
    return left.join(right, F.col("__date") == F.col("__join_date"), "left").drop("__date", "__join_date")


def distinct_dates(df: DataFrame, date_column: str) -> DataFrame:
    """Distinct non-null dates, as bounded as the calendar."""
    return df.select(as_date(date_column).alias("date")).where(F.col("date").isNotNull()).distinct()


def common_dates(df: DataFrame, date_column: str, other: DataFrame, other_date_column: str) -> DataFrame:
    return distinct_dates(df, date_column).intersect(distinct_dates(other, other_date_column))


def date_overlap(df: DataFrame, date_column: str, other: DataFrame, other_date_column: str) -> DataFrame:
    """Share of this table's distinct dates that the other table has; null for no dates."""
    mine = distinct_dates(df, date_column)
    theirs = distinct_dates(other, other_date_column).withColumnRenamed("date", "other_date")
    matched = mine.join(theirs, F.col("date") == F.col("other_date"), "left")
    n, common = F.count("date"), F.count("other_date")
    pct = F.try_divide(common * 100.0, n.cast("double"))
    return matched.agg(
        n.alias("n_dates"),
        common.alias("n_common"),
        F.round(pct, 1).alias("overlap_pct"),
        F.coalesce(pct >= MIN_OVERLAP_PCT, F.lit(False)).alias("accepted"),
    )


def holiday_flag(
    df: DataFrame,
    datetime_column: str,
    holidays: DataFrame | None = None,
    holiday_date_column: str | None = None,
    output_column: str = "is_holiday",
) -> DataFrame:
    """1 on a listed date, else 0; null for a null date, 0 without a holiday table."""
    if holidays is None:
        return df.withColumn(output_column, F.lit(0))
    if holiday_date_column is None:
        named = [f.name for f in holidays.schema.fields if "date" in f.name.lower()]
        typed = [f.name for f in holidays.schema.fields if f.dataType.typeName().startswith(("date", "timestamp"))]
        if not (named or typed):
            return df.withColumn(output_column, F.lit(0))
        holiday_date_column = (named or typed)[0]
    days = distinct_dates(holidays, holiday_date_column).withColumnRenamed("date", "__holiday")
    joined = df.withColumn("__date", as_date(datetime_column)).join(
        days, F.col("__date") == F.col("__holiday"), "left"
    )
    flag = F.when(F.col("__date").isNotNull(), F.col("__holiday").isNotNull().cast("int"))
    return joined.withColumn(output_column, flag).drop("__date", "__holiday")


def rank_joins(
    df: DataFrame,
    date_column: str,
    candidates: Mapping[str, tuple[DataFrame, str]],
    has_seasonality: bool = False,
) -> DataFrame:
    """Accepted outside tables by overlap, best first, with a confidence."""
    rows = []
    for name, (table, table_date) in candidates.items():
        overlap = date_overlap(df, date_column, table, table_date)
        rows.append(
            overlap.select(
                F.lit(name).alias("table_name"),
                "overlap_pct",
                F.lit(len(table.columns) - 1).cast("int").alias("n_features"),
                "accepted",
            )
        )
    base = F.least(F.col("overlap_pct") / 100.0, F.lit(MAX_CONFIDENCE))
    if has_seasonality:
        base = F.when(
            F.col("overlap_pct") > SEASONAL_MIN_OVERLAP,
            F.least(base + SEASONAL_BONUS, F.lit(SEASONAL_MAX_CONFIDENCE)),
        ).otherwise(base)
    ranked = reduce(DataFrame.unionByName, rows).where("accepted").drop("accepted")
    return ranked.withColumn("confidence", base).orderBy(F.col("overlap_pct").desc(), "table_name")


def join_future_exog(
    grid: DataFrame, exog: DataFrame, datetime_column: str, keys: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """Known future values for the forecast grid, matched on keys and time."""
    right = exog.select(
        *[col(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        col(datetime_column).cast("timestamp_ntz").alias("__ts"),
        *[col(f) for f in features],
    )
    on = [col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)]
    on.append(col(datetime_column).cast("timestamp_ntz") == F.col("__ts"))
    return grid.join(right, all_of(on), "left").drop("__ts", *[f"__key_{i}" for i in range(len(keys))])


def catalog_join(datasets: DataFrame, sources: DataFrame) -> DataFrame:
    """Each dataset with its earliest source, if it has one.

    ``min_by`` combines before the shuffle, so one dataset with very many sources is no hot task.
    """
    first = sources.groupBy(F.col("dataset_id").alias("__dataset")).agg(
        F.min_by(F.struct("source_type", "status"), F.struct("created_at", "id")).alias("__source")
    )
    return datasets.join(first, F.col("id") == F.col("__dataset"), "left").select(
        *[col(c) for c in datasets.columns],
        F.col("__source.source_type").alias("source_type"),
        F.col("__source.status").alias("source_status"),
    )


def run_dataset_join(runs: DataFrame, datasets: DataFrame, fallbacks: Mapping[str, str]) -> DataFrame:
    """Runs with their dataset; a missing run setting falls back to a dataset column."""
    right = datasets.select(
        F.col("id").alias("__dataset"),
        F.col("name").alias("dataset_name"),
        *[col(source).alias(f"__fallback_{setting}") for setting, source in fallbacks.items()],
    )
    joined = runs.join(right, F.col("dataset_id") == F.col("__dataset"), "inner")
    resolved = {s: F.coalesce(col(s), F.col(f"__fallback_{s}")) for s in fallbacks}
    return joined.withColumns(resolved).drop("__dataset", *[f"__fallback_{s}" for s in fallbacks])


def latest_by(df: DataFrame, group_by: Sequence[str], order: str, tiebreak: str) -> DataFrame:
    """Newest row per group as an aggregate, so a hot group is combined before the shuffle."""
    newest = F.max_by(F.struct(*[col(c) for c in df.columns]), F.struct(col(order), col(tiebreak)))
    return df.groupBy(*[col(g) for g in group_by]).agg(newest.alias("__row")).select("__row.*")


