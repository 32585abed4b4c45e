"""Grouped and whole-table aggregations, resampling, summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col, numeric_columns, require
from tidemark.functions.frequency import bucket_start, parse_frequency
from tidemark.operators.keys import attach
from tidemark.operators.stats import correlation, iqr_bounds, percent, quantiles

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "avg": F.avg,
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
}

# The only frequencies a source-side pre-aggregation accepts.
PRE_AGGREGATE_CODES = ("H", "1H", "D", "1D", "W", "1W", "M", "1M", "Q", "Y")


def _aggregate(name: str) -> Callable[[Column], Column]:
    key = (name or "mean").lower()
    if key not in AGGREGATES:
        raise ValueError(f"unknown aggregation {name!r}; use one of {sorted(AGGREGATES)}")
    return AGGREGATES[key]


def aggregate(df: DataFrame, group_by: str | Sequence[str], agg_column: str, agg_function: str = "mean") -> DataFrame:
    """One aggregate per group; ``count`` counts non-null values and null is a group."""
    groups = [group_by] if isinstance(group_by, str) else list(group_by)
    require(df, *groups, agg_column)
    made = _aggregate(agg_function)(col(agg_column)).alias(agg_column)
    return df.groupBy(*[col(g) for g in groups]).agg(made)


def resample(
    df: DataFrame,
    datetime_column: str,
    frequency: str = "D",
    agg_function: str = "mean",
    value_columns: str | Sequence[str] | None = None,
    keys: Sequence[str] = (),
    tiebreak: str | None = None,
) -> DataFrame:
    """Left-closed, left-labelled buckets; only buckets with rows appear.

    Without value columns every numeric column is aggregated. ``first`` and ``last``
    follow the time and, for equal times, the tiebreak column.
    """
    require(df, datetime_column, *keys)
    if isinstance(value_columns, str):
        value_columns = [value_columns]
    names = list(value_columns or numeric_columns(df, {datetime_column, *keys}))
    if not names:
        raise ValueError("resample needs a value column or at least one numeric column")
    require(df, *names)
    order = col(datetime_column) if tiebreak is None else F.struct(col(datetime_column), col(tiebreak))
    lowered = (agg_function or "mean").lower()
    if lowered == "first":
        made = [F.min_by(col(c), F.when(col(c).isNotNull(), order)).alias(c) for c in names]
    elif lowered == "last":
        made = [F.max_by(col(c), F.when(col(c).isNotNull(), order)).alias(c) for c in names]
    else:
        made = [_aggregate(lowered)(col(c)).alias(c) for c in names]
    bucket = bucket_start(col(datetime_column), frequency).alias(datetime_column)
    return df.groupBy(*[col(k) for k in keys], bucket).agg(*made)


def pre_aggregate(
    df: DataFrame,
    datetime_column: str,
    target_columns: Sequence[str],
    group_columns: Sequence[str] = (),
    frequency: str = "D",
    aggregation: str = "sum",
) -> DataFrame:
    """Calendar roll-up of a source before it is stored, ordered by time and groups."""
    if not target_columns:
        raise ValueError("target_columns must list at least one column")
    if frequency.upper() not in PRE_AGGREGATE_CODES:
        raise ValueError(f"frequency {frequency!r} not supported; use one of {PRE_AGGREGATE_CODES}")
    require(df, datetime_column, *target_columns, *group_columns)
    bucket = bucket_start(col(datetime_column), parse_frequency(frequency.upper())).alias(datetime_column)
    made = [_aggregate(aggregation)(col(c)).alias(c) for c in target_columns]
    grouped = df.groupBy(bucket, *[col(g) for g in group_columns]).agg(*made)
    return grouped.orderBy(col(datetime_column), *[col(g) for g in group_columns])


def dedup_mean(df: DataFrame, datetime_column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with equal time (and keys) become one row of numeric means."""
    require(df, datetime_column, *keys)
    names = numeric_columns(df, {datetime_column, *keys})
    return df.groupBy(*[col(k) for k in keys], col(datetime_column)).agg(
        *[F.avg(col(c)).alias(c) for c in names]
    )


def keep_last(df: DataFrame, datetime_column: str, tiebreak: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with equal time (and keys) become the one with the largest tiebreak.

    An aggregate, not a window: partial results keep a hot timestamp small before the shuffle.
    """
    require(df, datetime_column, tiebreak, *keys)
    rest = [c for c in df.columns if c not in (datetime_column, *keys)]
    last = F.max_by(F.struct(*[col(c) for c in rest]), col(tiebreak)).alias("__last")
    grouped = df.groupBy(*[col(k) for k in keys], col(datetime_column)).agg(last)
    picked = {c: F.col("__last").getField(c) for c in rest}
    return grouped.withColumns(picked).select(*[col(c) for c in df.columns])


def panel_mean(df: DataFrame, datetime_column: str, target: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*[col(k) for k in keys], col(datetime_column)).agg(F.avg(col(target)).alias("value"))


def panel_total(df: DataFrame, datetime_column: str, target: str) -> DataFrame:
    return df.groupBy(col(datetime_column)).agg(F.sum(col(target)).alias(target))


def group_stats(df: DataFrame, keys: Sequence[str], small: int = 30) -> DataFrame:
    """Number and sizes of groups; the median is over one count per group."""
    sizes = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("n").alias("min_group_size"),
        F.max("n").alias("max_group_size"),
        F.count_if(F.col("n") < small).alias("small_groups"),
    )
    # Equal sizes first become one row with a weight, so the median state stays small.
    weighted = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("w"))
    median = weighted.agg(F.floor(F.percentile("n", 0.5, F.col("w"))).alias("median_group_size"))
    return attach(stats, median, [], ["median_group_size"])


def duplicate_count(df: DataFrame, datetime_column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first per time (and keys); a null time counts as one value."""
    distinct = F.count_distinct(F.struct(*[col(k) for k in keys], col(datetime_column)))
    return df.agg((F.count(F.lit(1)) - distinct).alias("n_duplicates"))


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None, only_missing: bool = False) -> DataFrame:
    """Null count and percentage per column, from one pass over the table."""
    names = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(col(c).isNull()).alias(f"__m{i}") for i, c in enumerate(names)],
    )
    rows = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.col(f"__m{i}").alias("missing")) for i, c in enumerate(names)]
        )
    )
    out = counted.select("__n", rows.alias("r")).select(
        F.col("r.column_name").alias("column_name"),
        F.col("r.missing").alias("missing"),
        F.round(percent(F.col("r.missing"), F.col("__n")), 2).alias("missing_pct"),
    )
    if only_missing:
        out = out.where(F.col("missing") > 0).orderBy(F.col("missing").desc(), "column_name")
    return out


DESCRIBED_QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "banded") -> DataFrame:
    """Count, nulls, mean, sample deviation, minimum, quartiles and maximum per numeric column.

    One aggregate for all columns; the quartiles come from one ordered pass over the
    distinct (column, value) pairs with their counts, so no task holds a whole column.
    """
    names = list(columns or numeric_columns(df))
    aggregates = []
    for i, name in enumerate(names):
        c = col(name).cast("double")
        fields = [
            F.lit(name).alias("column_name"),
            F.count(c).alias("count"),
            F.count_if(c.isNull()).alias("null_count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        ]
        aggregates.append(F.struct(*fields).alias(f"d{i}"))
    stats = df.agg(*aggregates)
    rows = stats.select(F.explode(F.array(*[f"d{i}" for i in range(len(names))])).alias("d")).select("d.*")
    cells = F.array(*[F.struct(F.lit(n).alias("column_name"), col(n).cast("double").alias("v")) for n in names])
    quartiles = quantiles(df.select(F.inline(cells)), "v", DESCRIBED_QUANTILES, ["column_name"], strategy=strategy)
    joined = attach(rows, quartiles, ["column_name"], list(DESCRIBED_QUANTILES))
    return joined.select("column_name", "count", "null_count", "mean", "std", "min", *DESCRIBED_QUANTILES, "max")


def preview_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rounded mean, deviation, minimum and maximum per numeric column, in one pass."""
    names = list(columns or numeric_columns(df))
    made = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.round(F.avg(col(c)), 4).alias("mean"),
                F.round(F.stddev_samp(col(c)), 4).alias("std"),
                F.round(F.min(col(c)).cast("double"), 4).alias("min"),
                F.round(F.max(col(c)).cast("double"), 4).alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(names)
        ]
    )
    return made.select(F.explode(F.array(*[f"s{i}" for i in range(len(names))])).alias("s")).select("s.*")


def target_stats(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """One pass: counts, mean, deviation, range, shares of zeros and negatives."""
    return df.groupBy(*[col(k) for k in keys]).agg(*target_stat_columns(target))


def target_stat_columns(target: str) -> list[Column]:
    v = col(target).try_cast("double")
    n = F.count(v)
    return [
        n.alias("count"),
        F.count_if(v.isNull()).alias("missing"),
        F.round(percent(F.count_if(v.isNull()), F.count(F.lit(1))), 2).alias("missing_pct"),
        F.round(F.coalesce(F.avg(v), F.lit(0.0)), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4).alias("std"),
        F.round(F.coalesce(F.min(v), F.lit(0.0)), 4).alias("min"),
        F.round(F.coalesce(F.max(v), F.lit(0.0)), 4).alias("max"),
        F.round(percent(F.count_if(v == 0), n), 2).alias("zeros_pct"),
        F.round(percent(F.count_if(v < 0), n), 2).alias("negative_pct"),
    ]


def iqr_outliers(
    df: DataFrame,
    target: str,
    keys: Sequence[str] = (),
    min_values: int = 4,
    method: str = "linear",
    strategy: str = "banded",
) -> DataFrame:
    """Values outside the interquartile fences; 0 for short or constant-middle series."""
    values = df.select(*[col(k) for k in keys], col(target).try_cast("double").alias("__v"))
    fences = iqr_bounds(values, "__v", keys, method, strategy)
    packed = fences.select(
        *[col(k) for k in keys], F.struct("q1", "q3", "lower", "upper").alias("__f")
    )
    tagged = attach(values, packed, keys, ["__f"])
    v, f = F.col("__v"), F.col("__f")
    n = F.count(v)
    outside = F.count_if((v < f["lower"]) | (v > f["upper"]))
    usable = (n >= min_values) & (F.max(f["q3"]) > F.max(f["q1"]))
    counted = F.when(usable, outside).otherwise(F.lit(0).cast("long"))
    return tagged.groupBy(*[col(k) for k in keys]).agg(
        F.max(f["lower"]).alias("lower"),
        F.max(f["upper"]).alias("upper"),
        counted.alias("outliers"),
        F.round(percent(counted, n), 2).alias("outliers_pct"),
    )


def zscore_outliers(df: DataFrame, target: str, keys: Sequence[str] = (), limit: float = 3.0) -> DataFrame:
    """Values further than ``limit`` sample deviations from the mean."""
    values = df.select(*[col(k) for k in keys], col(target).try_cast("double").alias("__v"))
    moments = values.groupBy(*[col(k) for k in keys]).agg(
        F.struct(F.avg("__v").alias("m"), F.stddev_samp("__v").alias("s")).alias("__z")
    )
    tagged = attach(values, moments, keys, ["__z"])
    far = F.abs(F.col("__v") - F.col("__z.m")) / F.nullif(F.col("__z.s"), F.lit(0.0)) > limit
    n = F.count("__v")
    return tagged.groupBy(*[col(k) for k in keys]).agg(
        F.count_if(far).alias("outliers_count"), percent(F.count_if(far), n).alias("outliers_pct")
    )


def skewness(df: DataFrame, target: str, keys: Sequence[str] = (), min_values: int = 4) -> DataFrame:
    """Population skewness m3 / m2^1.5; 0 for a constant, null below four values."""
    return df.groupBy(*[col(k) for k in keys]).agg(skewness_column(target, min_values))


def skewness_column(target: str, min_values: int = 4) -> Column:
    v = col(target).try_cast("double")
    constant = F.coalesce(F.var_pop(v), F.lit(0.0)) == 0
    made = F.when(F.count(v) >= min_values, F.when(constant, 0.0).otherwise(F.skewness(v)))
    return F.round(made, 4).alias("skewness")


def value_counts(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    require(df, column)
    counted = df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.col("count").desc(), col(column).asc_nulls_first()).limit(top_n)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson for every ordered pair, all pairs in one aggregation."""
    names = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    made = df.agg(*[correlation(col(a), col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"c{i}").alias("corr")))
    return made.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def correlation_with(df: DataFrame, target: str, columns: Sequence[str] | None = None, top_n: int = 10) -> DataFrame:
    """Columns with the largest absolute correlation to the target."""
    names = [c for c in (columns or numeric_columns(df)) if c != target]
    made = df.agg(*[F.abs(correlation(col(target), col(c))).alias(f"c{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("abs_corr")) for i, c in enumerate(names)]
    rows = made.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rows.orderBy(F.col("abs_corr").desc_nulls_last(), "column_name").limit(top_n)


def date_range(df: DataFrame, datetime_column: str, keys: Sequence[str] = ()) -> DataFrame:
    ts = col(datetime_column).try_cast("timestamp_ntz")
    return df.groupBy(*[col(k) for k in keys]).agg(
        F.to_date(F.min(ts)).alias("start_date"), F.to_date(F.max(ts)).alias("end_date")
    )


def data_age(df: DataFrame, datetime_column: str, as_of: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Whole days from the last row to ``as_of`` and the last date."""
    last = last_times(df, datetime_column, keys)
    return last.select(*[col(k) for k in keys], *age_columns(F.col("last_time"), as_of))


def last_times(df: DataFrame, datetime_column: str, keys: Sequence[str] = ()) -> DataFrame:
    last = F.max(col(datetime_column).try_cast("timestamp_ntz")).alias("last_time")
    return df.groupBy(*[col(k) for k in keys]).agg(last)


def age_columns(last: Column, as_of: Column) -> list[Column]:
    """Row expressions on a maximum that was already taken; ``as_of`` may be a scalar subquery."""
    seconds = F.timestamp_diff("SECOND", last, as_of.cast("timestamp_ntz"))
    return [
        F.floor(seconds / 86400).cast("int").alias("data_age_days"),
        F.to_date(last).alias("last_data_date"),
    ]
