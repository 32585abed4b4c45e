"""Profiles of tables and series, the issues they show and the preparation they call for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col, is_numeric, is_temporal, numeric_columns, require
from tidemark.functions.frequency import frequency_code
from tidemark.operators.aggregate import (
    age_columns,
    date_range,
    duplicate_count,
    group_stats,
    iqr_outliers,
    missing_summary,
    skewness_column,
    target_stat_columns,
    zscore_outliers,
)
from tidemark.operators.keys import attach, key_columns
from tidemark.operators.series import frequency_gaps, gap_lengths, seasonality, trend_concordance
from tidemark.operators.stats import percent, quantiles
from tidemark.session import materialize

# Name fragments of datetime and target columns.
DATETIME_NAMES = ("date", "time", "timestamp", "dt", "datetime", "data", "dzien", "miesiac")
TARGET_NAMES = ("value", "sales", "revenue", "price", "amount", "count", "target", "y")


def detect_datetime(df: DataFrame) -> str | None:
    """A temporal column, else a column named like a time that parses, else text that parses.

    A column parses if every non-null value of the table does; one aggregate tells it for all.
    """
    for f in df.schema.fields:
        if is_temporal(f.dataType):
            return f.name
    named = [f.name for f in df.schema.fields if not is_numeric(f.dataType) and any(w in f.name.lower() for w in DATETIME_NAMES)]
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name not in named]
    if not named + text:
        return None
    values = [col(name).cast("string") for name in named + text]
    counts = df.agg(*[F.struct(F.count(v), F.count(v.try_cast("timestamp_ntz"))) for v in values]).first()
    return next((name for name, (seen, parsed) in zip(named + text, counts, strict=True) if 0 < seen == parsed), None)


def detect_target(df: DataFrame, datetime_column: str | None = None, fallback: bool = True) -> str | None:
    """The only numeric column, else one named like a measure, else (optionally) the first."""
    numeric = numeric_columns(df, {datetime_column} if datetime_column else ())
    if len(numeric) == 1:
        return numeric[0]
    for name in numeric:
        if any(w in name.lower() for w in TARGET_NAMES):
            return name
    return numeric[0] if numeric and fallback else None


SAMPLES = 3


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: type, nulls, distinct values (null is one value), the three smallest as text.

    Distinct values are counted as (column, value) pairs, combined before the shuffle;
    ``exact=False`` counts them with a sketch instead.
    """
    names = df.columns
    aggregates = []
    for i, name in enumerate(names):
        aggregates.append(F.count_if(col(name).isNull()).alias(f"m{i}"))
        if not exact:
            aggregates.append(F.approx_count_distinct(col(name)).alias(f"u{i}"))
    counted = df.agg(*aggregates)
    cells = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("n_missing"),
            (F.lit(None).cast("long") if exact else F.col(f"u{i}")).alias("__sketched"),
            F.lit(is_temporal(f.dataType)).alias("is_datetime"),
            F.lit(is_numeric(f.dataType)).alias("is_numeric"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    rows = counted.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    values = F.array(*[F.struct(F.lit(n).alias("__name"), col(n).cast("string").alias("v")) for n in names])
    pairs = df.select(F.inline(values)).where(F.col("v").isNotNull()).groupBy("__name", "v").agg(F.count(F.lit(1)).alias("n"))
    smallest = pairs.withColumn("__i", F.row_number().over(Window.partitionBy("__name").orderBy("v"))).where(F.col("__i") <= SAMPLES)
    found = smallest.groupBy("__name").agg(F.array_sort(F.collect_list("v")).alias("sample_values"))
    if exact:
        found = pairs.groupBy("__name").agg(F.count(F.lit(1)).alias("__distinct")).join(found, "__name")
    else:
        found = found.withColumn("__distinct", F.lit(None).cast("long"))
    joined = rows.join(found, rows["column_name"] == found["__name"], "left")
    distinct = F.coalesce("__sketched", "__distinct", F.lit(0).cast("long")) + (F.col("n_missing") > 0).cast("long")
    samples = F.coalesce("sample_values", F.array().cast("array<string>"))
    return joined.select("column_name", "dtype", "n_missing", distinct.alias("n_unique"), "is_datetime", "is_numeric", samples.alias("sample_values"))


def infer_frequency(
    df: DataFrame, datetime_column: str, keys: Sequence[str] = (), strategy: str = "banded", bands: int | None = None
) -> DataFrame:
    """Frequency label per series from the median gap; null below three rows."""
    gaps = gap_lengths(df, datetime_column, keys, strategy, bands)
    if strategy != "keyed":
        # Regular series have few distinct gaps; store them before asking how many there are.
        gaps = materialize(gaps, "gaps")
    median = quantiles(gaps, "delta_seconds", {"median_seconds": 0.5}, keys, strategy=strategy, weight="n")
    by = key_columns(keys)
    counts = df.where(col(datetime_column).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    both = attach(counts, median, keys, ["median_seconds"])
    code = F.when(F.col("n_rows") >= 3, frequency_code(F.col("median_seconds")))
    return both.select(*by, "median_seconds", code.alias("frequency"))


def validate_series(df: DataFrame, datetime_column: str, value_column: str = "value", min_points: int = 10) -> DataFrame:
    """One row: ``valid``, counts and the list of errors."""
    require(df, datetime_column, value_column)
    n = F.count(F.lit(1))
    distinct = F.count_distinct(F.struct(col(datetime_column)))
    stats = df.agg(
        n.alias("n_points"),
        F.count_if(col(value_column).isNull()).alias("n_missing"),
        (n > distinct).alias("has_duplicates"),
    )
    errors = F.array_compact(
        F.array(
            F.when(F.col("has_duplicates"), F.lit("Duplicate timestamps found")),
            F.when(
                F.col("n_points") < min_points,
                F.concat(F.lit("Too few data points: "), F.col("n_points").cast("string"), F.lit(f" < {min_points}")),
            ),
        )
    )
    return stats.select(
        (F.size(errors) == 0).alias("valid"),
        "n_points",
        (F.col("n_missing") > 0).alias("has_missing"),
        "n_missing",
        "has_duplicates",
        errors.alias("errors"),
    )


def identify_issues(df: DataFrame, datetime_column: str | None = None) -> DataFrame:
    """Rows ``(issue, subject, amount)``: columns over 5% missing, under 10 rows, duplicate times."""
    missing = missing_summary(df).where(F.col("missing_pct") > 5)
    out = missing.select(
        F.lit("missing").alias("issue"), F.col("column_name").alias("subject"), F.col("missing").alias("amount")
    )
    rows = df.agg(F.count(F.lit(1)).alias("amount")).where(F.col("amount") < 10)
    out = out.unionByName(rows.select(F.lit("few_rows").alias("issue"), F.lit("table").alias("subject"), "amount"))
    if datetime_column:
        repeated = duplicate_count(df, datetime_column).where(F.col("n_duplicates") > 0)
        out = out.unionByName(
            repeated.select(
                F.lit("duplicates").alias("issue"),
                F.lit(datetime_column).alias("subject"),
                F.col("n_duplicates").alias("amount"),
            )
        )
    return out


def data_quality(df: DataFrame, datetime_column: str, target: str, as_of: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, nulls, z-score outliers, age and range of the target, one row per key."""
    by = key_columns(keys)
    v = col(target).try_cast("double")
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(v.isNull()).alias("missing_count"),
        percent(F.count_if(v.isNull()), F.count(F.lit(1))).alias("missing_pct"),
        F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, F.lit(0.0))).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.max(col(datetime_column).try_cast("timestamp_ntz")).alias("__last"),
    )
    aged = stats.select("*", *age_columns(F.col("__last"), as_of)).drop("__last")
    return attach(aged, zscore_outliers(df, target, keys), keys, ["outliers_count", "outliers_pct"])


def series_profile(
    df: DataFrame,
    datetime_column: str,
    target: str,
    frequency: str | None = None,
    keys: Sequence[str] = (),
    strategy: str = "banded",
) -> DataFrame:
    """Per series: frequency, range, missing and outlier shares, seasonality, trend, advice."""
    by = key_columns(keys)
    v = col(target)
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(percent(F.count_if(v.isNull()), F.count(F.lit(1))), 2).alias("missing_pct"),
    )
    out = attach(base, infer_frequency(df, datetime_column, keys, strategy), keys, ["frequency"])
    out = attach(out, date_range(df, datetime_column, keys), keys, ["start_date", "end_date"])
    outliers = iqr_outliers(df, target, keys, 4, strategy=strategy).withColumnRenamed("outliers_pct", "outlier_pct")
    out = attach(out, outliers, keys, ["outlier_pct"])
    seasons = seasonality(df, target, datetime_column, frequency, keys, strategy)
    out = attach(out, seasons, keys, ["has_seasonality", "seasonality_period"])
    out = attach(out, trend_concordance(df, target, datetime_column, keys, strategy), keys, ["has_trend"])
    missing, outlier, n = F.col("missing_pct"), F.col("outlier_pct"), F.col("n_rows")
    method = (
        F.when(missing > 20, "drop_rows")
        .when(F.coalesce("has_seasonality", F.lit(False)), "seasonal_interp")
        .otherwise("linear_interp")
    )
    severity = F.when(missing > 10, "high").when(missing > 2, "medium").otherwise("low")
    advice = F.array_compact(
        F.array(
            F.when(missing > 0, _advice("fill_missing", method, severity)),
            F.when(
                outlier > 2,
                _advice("handle_outliers", F.lit("clip_iqr"), F.when(outlier < 10, "medium").otherwise("high")),
            ),
            F.when(n < 30, _advice("warning", F.lit("insufficient_data"), F.lit("high"))),
        )
    )
    return out.withColumns(
        {"recommendations": advice, "needs_confirmation": (missing > 5) | (F.coalesce(outlier, F.lit(0.0)) > 5)}
    )


def _advice(kind: str, method: Column, severity: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), method.alias("method"), severity.alias("severity"))


def _issue(name: str, severity: Column | str, *message: Column | str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
    return F.struct(F.lit(name).alias("id"), level.alias("severity"), F.concat(*parts).alias("message"))


def wizard_analysis(
    df: DataFrame,
    datetime_column: str,
    target: str,
    as_of: Column,
    keys: Sequence[str] = (),
    strategy: str = "banded",
    bands: int | None = None,
) -> DataFrame:
    """One row with every statistic the preparation rules need, and the issues found.

    Gaps are taken within a series and duplicates within (time, keys).
    """
    require(df, datetime_column, target, *keys)
    # First pass: everything that is a plain aggregate of the rows.
    ts = col(datetime_column).try_cast("timestamp_ntz")
    first = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(ts).alias("__last"), *target_stat_columns(target), skewness_column(target)
    )
    age = age_columns(F.col("__last"), as_of)[0]
    out = first.withColumn("n_columns", F.lit(len(df.columns))).withColumn("data_age_days", age).drop("__last")
    # Below eleven values the shares stay 0, like an analysis that skipped outliers.
    fences = iqr_outliers(df, target, (), 11, strategy=strategy)
    out = attach(out, fences, [], ["lower", "upper", "outliers", "outliers_pct"])
    gaps = frequency_gaps(df, datetime_column, keys, strategy, bands)
    total = gaps.agg(
        F.coalesce(F.sum("frequency_gaps"), F.lit(0)).alias("frequency_gaps"), F.sum("intervals").alias("intervals")
    )
    shares = total.withColumn("frequency_gap_pct", F.round(percent(F.col("frequency_gaps"), F.col("intervals")), 2))
    out = attach(out, shares, [], ["frequency_gaps", "frequency_gap_pct"])
    out = attach(out, duplicate_count(df, datetime_column, keys), [], ["n_duplicates"])
    if keys:
        sizes = group_stats(df, keys)
        out = attach(out, sizes, [], sizes.columns)
    else:
        out = out.withColumns(
            {
                "n_groups": F.lit(1).cast("long"),
                "min_group_size": F.col("n_rows"),
                "max_group_size": F.col("n_rows"),
                "median_group_size": F.col("n_rows"),
                "small_groups": F.lit(0).cast("long"),
            }
        )
    missing = F.col("missing_pct")
    found = [
        F.when(
            F.col("missing") > 0,
            _issue(
                "missing_target",
                F.when(missing > 10, "high").when(missing > 1, "warning").otherwise("info"),
                F.col("missing"), " missing target values (", missing, "%)",
            ),
        ),
        F.when(F.col("outliers_pct") > 5, _issue("outliers", "warning", F.col("outliers"), " values outside the fences")),
        F.when(F.col("zeros_pct") > 50, _issue("high_zeros", "warning", F.col("zeros_pct"), "% of values are zero")),
        F.when(F.col("negative_pct") > 0, _issue("negative_values", "warning", F.col("negative_pct"), "% of values are negative")),
        F.when(F.col("frequency_gap_pct") > 5, _issue("frequency_gaps", "warning", F.col("frequency_gaps"), " irregular time gaps")),
        F.when(F.col("n_duplicates") > 0, _issue("duplicate_timestamps", "warning", F.col("n_duplicates"), " duplicate timestamps")),
        F.when(F.col("data_age_days") > 30, _issue("stale_data", "high", "data is ", F.col("data_age_days"), " days old")),
        F.when(F.col("small_groups") > 0, _issue("small_groups", "warning", F.col("small_groups"), " groups under 30 rows")),
        F.when(F.col("n_rows") < 50, _issue("small_dataset", "high", "only ", F.col("n_rows"), " rows")),
    ]
    return out.withColumn("issues", F.array_compact(F.array(*found)))


@dataclass(frozen=True)
class PreparationStep:
    id: str
    choice: str
    options: tuple[str, ...]
    enabled: bool = True


def suggest_preparations(analysis: dict[str, Any]) -> list[PreparationStep]:
    """Rules on one collected ``wizard_analysis`` row."""
    issues = {i["id"] for i in analysis["issues"]}
    steps: list[PreparationStep] = []
    if "missing_target" in issues:
        pct = analysis["missing_pct"]
        choice = "drop" if pct > 20 else "interpolate" if pct > 5 else "forward_fill"
        steps.append(PreparationStep("fill_missing", choice, ("forward_fill", "interpolate", "drop", "skip")))
    if "outliers" in issues:
        width = (analysis["upper"] or 0.0) - (analysis["lower"] or 0.0)
        pct = analysis["outliers_pct"]
        if analysis["zeros_pct"] > 50 or width < 0.01:
            choice = "keep"
        else:
            choice = "remove" if pct > 20 else "clip" if pct > 10 else "keep"
        steps.append(PreparationStep("handle_outliers", choice, ("clip", "remove", "keep"), choice != "keep"))
    if "duplicate_timestamps" in issues:
        steps.append(PreparationStep("handle_duplicates", "aggregate_mean", ("aggregate_mean", "keep_last", "skip")))
    if "frequency_gaps" in issues and analysis["frequency_gap_pct"] > 10:
        steps.append(
            PreparationStep("fix_frequency", "resample_ffill", ("resample_ffill", "resample_interpolate", "skip"))
        )
    return steps or [PreparationStep("no_prep_needed", "continue", ("continue",), False)]


def suggest_preparation_columns(profiles: DataFrame) -> DataFrame:
    """The same choices for many series at once, as columns on rows of statistics."""
    missing, outliers = F.col("missing_pct"), F.col("outliers_pct")
    width = F.coalesce(F.col("upper") - F.col("lower"), F.lit(0.0))
    return profiles.withColumns(
        {
            "fill_choice": F.when(missing > 20, "drop").when(missing > 5, "interpolate").when(missing > 0, "forward_fill").otherwise("none"),
            "outlier_choice": F.when(outliers <= 5, "none")
            .when((F.col("zeros_pct") > 50) | (width < 0.01), "keep")
            .when(outliers > 20, "remove")
            .when(outliers > 10, "clip")
            .otherwise("keep"),
        }
    )
