"""Projections, filters and row-level rewrites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import (
    all_of,
    col,
    is_numeric,
    is_temporal,
    parse_bound,
    require,
    temporal_columns,
    typed_literal,
)
from tidemark.operators.keys import attach
from tidemark.operators.stats import iqr_bounds

# Outlier handling needs more values than this and fences at least this far apart.
MIN_VALUES_FOR_FENCES = 10
MIN_FENCE_WIDTH = 0.01


def to_series(df: DataFrame, datetime_column: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Keys, time and the target as ``value``; rows without a value are dropped."""
    require(df, datetime_column, target, *keys)
    return df.select(*[col(k) for k in keys], col(datetime_column), col(target).alias("value")).where(
        F.col("value").isNotNull()
    )


def drop_columns(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """A single name must exist; names in a list may be missing."""
    if isinstance(columns, str):
        require(df, columns)
        return df.drop(columns)
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    require(df, *mapping)
    return df.withColumnsRenamed(dict(mapping))


def add_column(df: DataFrame, column_name: str, expression: str) -> DataFrame:
    """New column from Spark SQL expression text; registered SQL functions may be used."""
    return df.withColumn(column_name, F.expr(expression))


def cast_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Non-strict casts: values that do not fit become null."""
    require(df, *types)
    names = {"datetime": "timestamp_ntz", "numeric": "double"}
    return df.withColumns({c: col(c).try_cast(names.get(t, t)) for c, t in types.items()})


def combine_datetime(
    df: DataFrame,
    date_column: str,
    time_column: str,
    output_column: str = "datetime",
    drop_original: bool = False,
) -> DataFrame:
    """Date text and time text to one timestamp; null when either is null or unreadable."""
    require(df, date_column, time_column)
    text = F.concat(col(date_column).cast("string"), F.lit(" "), col(time_column).cast("string"))
    out = df.withColumn(output_column, text.try_cast("timestamp_ntz"))
    if drop_original:
        out = out.drop(*[c for c in (date_column, time_column) if c != output_column])
    return out


def filter_rows(df: DataFrame, column: str, condition: str, value: object) -> DataFrame:
    require(df, column)
    left, right = col(column), typed_literal(df, column, value)
    compare = {
        ">": left > right,
        "<": left < right,
        "==": left == right,
        "!=": left != right,
        ">=": left >= right,
        "<=": left <= right,
    }
    if condition.strip() not in compare:
        raise ValueError(f"unknown condition {condition!r}")
    return df.where(compare[condition.strip()])


def filter_date_range(
    df: DataFrame,
    start: str | date | datetime | None = None,
    end: str | date | datetime | None = None,
    column: str | None = None,
) -> DataFrame:
    """Inclusive on both ends. Bounds take the column's type, so the scan can use them."""
    if column is None:
        found = temporal_columns(df)
        if not found:
            raise ValueError("no datetime column found; name one")
        column = found[0]
    require(df, column)
    data_type = df.schema[column].dataType
    conditions: list[Column] = []
    if isinstance(data_type, T.DateType):
        # A date equals its midnight: round the bounds inwards to whole days.
        if start is not None:
            low = parse_bound(start)
            day = low.date() if low.time() == time.min else low.date() + timedelta(days=1)
            conditions.append(col(column) >= F.lit(day))
        if end is not None:
            conditions.append(col(column) <= F.lit(parse_bound(end).date()))
    else:
        ts = col(column) if is_temporal(data_type) else col(column).try_cast("timestamp_ntz")
        kind = data_type if is_temporal(data_type) else T.TimestampNTZType()
        if start is not None:
            conditions.append(ts >= F.lit(str(parse_bound(start))).cast(kind))
        if end is not None:
            conditions.append(ts <= F.lit(str(parse_bound(end))).cast(kind))
    return df.where(all_of(conditions)) if conditions else df


def non_null_count(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for name in columns:
        total = total + col(name).isNotNull().cast("int")
    return total


def drop_missing(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    min_non_null: int | None = None,
    min_fraction: float | None = None,
) -> DataFrame:
    """Drop rows with a null in any (given) column, or with too few non-null values."""
    if isinstance(columns, str):
        require(df, columns)
        columns = [columns]
    if min_fraction is not None:
        min_non_null = int(len(df.columns) * min_fraction)
    if columns is None and min_non_null is not None:
        return df.where(non_null_count(df.columns) >= min_non_null)
    return df.dropna("any", subset=list(columns) if columns else None)


def clip_negative(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    zero = F.lit(0).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(col(column) < zero, zero).otherwise(col(column)))


def handle_outliers(
    df: DataFrame,
    column: str,
    how: str = "clip",
    keys: Sequence[str] = (),
    method: str = "linear",
    strategy: str = "banded",
) -> DataFrame:
    """Clip to, or drop rows outside, the interquartile fences (per key if given).

    Series with too few values or nearly equal fences stay as they are.
    """
    require(df, column, *keys)
    fences = iqr_bounds(df, column, keys, method, strategy)
    counts = df.groupBy(*[col(k) for k in keys]).agg(F.count(col(column)).alias("n"))
    stats = attach(fences, counts, keys, ["n"])
    tagged = attach(
        df, stats.select(*[col(k) for k in keys], F.struct("lower", "upper", "n").alias("__f")), keys, ["__f"]
    )
    low, high, n = (F.col("__f").getField(x) for x in ("lower", "upper", "n"))
    usable = F.coalesce(
        (n > MIN_VALUES_FOR_FENCES) & (F.abs(high - low) >= MIN_FENCE_WIDTH), F.lit(False)
    )
    value = col(column)
    if how == "clip":
        clipped = F.when(value < low, low).when(value > high, high).otherwise(value)
        return tagged.withColumn(column, F.when(usable, clipped).otherwise(value)).drop("__f")
    if how == "remove":
        return tagged.where(~usable | value.between(low, high)).drop("__f")
    raise ValueError(f"unknown outlier handling {how!r}")


def normalize(
    df: DataFrame,
    column: str,
    method: str = "min_max",
    output_column: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Min-max or z-score with the sample deviation; a constant column becomes 0.0."""
    require(df, column, *keys)
    if method == "min_max":
        shift, scale = F.min(col(column)), F.max(col(column)) - F.min(col(column))
    elif method == "z_score":
        shift, scale = F.avg(col(column)), F.stddev_samp(col(column))
    else:
        raise ValueError(f"unknown normalization {method!r}")
    stats = df.groupBy(*[col(k) for k in keys]).agg(
        F.struct(shift.cast("double").alias("shift"), scale.cast("double").alias("scale")).alias("__s")
    )
    out = attach(df, stats, keys, ["__s"])
    moved = (col(column) - F.col("__s.shift")) / F.nullif(F.col("__s.scale"), F.lit(0.0))
    degenerate = F.coalesce(F.col("__s.scale"), F.lit(0.0)) == 0.0
    return out.withColumn(
        output_column or f"{column}_normalized", F.when(degenerate, F.lit(0.0)).otherwise(moved)
    ).drop("__s")


def filter_series(df: DataFrame, series: Mapping[str, object]) -> DataFrame:
    """Rows of one series, given as key column -> value."""
    for name, value in series.items():
        df = filter_rows(df, name, "==", value)
    return df


def drop_non_numeric_target(df: DataFrame, target: str, datetime_column: str | None = None) -> DataFrame:
    """Cast target (and time) non-strictly and drop what became null."""
    casts = {}
    if not is_numeric(df.schema[target].dataType):
        casts[target] = "numeric"
    if datetime_column and not is_temporal(df.schema[datetime_column].dataType):
        casts[datetime_column] = "datetime"
    return cast_types(df, casts).dropna(subset=[target] + ([datetime_column] if datetime_column else []))


def sort_rows(df: DataFrame, column: str, ascending: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Nulls first in both directions.

    A hash of the row comes last, so that a value which fills much of the table is sorted
    by more than one task.
    """
    require(df, column, *tiebreak)
    first = col(column).asc_nulls_first() if ascending else col(column).desc_nulls_first()
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.orderBy(first, *[col(t).asc() for t in tiebreak], F.xxhash64(*[col(c) for c in hashable]))


def head(df: DataFrame, n: int = 10, order_by: Sequence[str] = (), columns: int | None = None) -> DataFrame:
    """A small look at a table: ``n`` rows, and the first ``columns`` columns if given."""
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    return ordered.limit(max(0, n)).select(*[col(c) for c in df.columns[:columns]])


def page(df: DataFrame, order_by: str, limit: int = 50, offset: int = 0, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest first; ``limit`` rows after ``offset`` ones."""
    order = [col(order_by).desc(), *[col(t).asc() for t in tiebreak]]
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))
