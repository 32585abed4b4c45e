"""Order-dependent operators of one or many series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.functions.frequency import parse_frequency
from tidemark.operators.keys import attach, key_columns
from tidemark.operators.sequence import sequence
from tidemark.operators.stats import correlation, percent

# Candidate seasonal lags by frequency and the threshold they must pass.
SEASONAL_LAGS = {
    "day": (7, 14, 30, 365),
    "week": (4, 13, 52),
    "month": (3, 6, 12),
    "hour": (24, 168),
    "minute": (96, 672),
}
ACF_THRESHOLD = 0.3
MAX_SCANNED_LAG = 365
MIN_SEASONAL_ROWS = 14

# Up to this many lags get a column each; more are read from one array per row.
MAX_LAG_COLUMNS = 16

# Rows of a run of the trend statistic, held by one task.
CELL_ROWS = 1 << 20
# Threshold and minimum length of the trend statistic.
TREND_THRESHOLD = 0.3
MIN_TREND_ROWS = 10

Order = str | Sequence[str]


def lag_feature(target: str, k: int) -> Callable:
    return lambda w: F.lag(col(target), k).over(w)


def rolling_mean_feature(target: str, window: int) -> Callable:
    return lambda w: F.avg(col(target)).over(w.rowsBetween(1 - window, 0))


def rolling_std_feature(target: str, window: int) -> Callable:
    return lambda w: F.stddev_samp(col(target)).over(w.rowsBetween(1 - window, 0))


def lags(df: DataFrame, target: str, order_by: Order, ks: Sequence[int], keys: Sequence[str] = (), strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """``lag_k``: the value k rows earlier in the same series."""
    made = {f"lag_{k}": lag_feature(target, k) for k in ks}
    return sequence(df, order_by, keys, strategy, bands).over(made, lookback=max(ks))


def rolling(df: DataFrame, target: str, order_by: Order, windows: Sequence[int], keys: Sequence[str] = (), statistics: Sequence[str] = ("mean", "std"), strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Trailing mean and sample deviation over w rows with the current one; one value is enough for a mean."""
    makers = {"mean": rolling_mean_feature, "std": rolling_std_feature}
    made = {f"rolling_{s}_{w}": makers[s](target, w) for w in windows for s in statistics}
    return sequence(df, order_by, keys, strategy, bands).over(made, lookback=max(windows) - 1)


def trend(df: DataFrame, order_by: Order, keys: Sequence[str] = (), output: str = "trend", strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """0-based row counter of each series."""
    return sequence(df, order_by, keys, strategy, bands).with_index(output)


def deltas(df: DataFrame, datetime_column: str, keys: Sequence[str] = (), tiebreak: Sequence[str] = (), strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """``delta_seconds`` to the previous row of the series; null times are left out."""
    stamped = df.where(col(datetime_column).isNotNull())

    def seconds(w):
        now = col(datetime_column).cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", F.lag(now).over(w), now) / 1e6

    order = [datetime_column, *tiebreak]
    return sequence(stamped, order, keys, strategy, bands).over({"delta_seconds": seconds}, lookback=1)


def gap_lengths(df: DataFrame, datetime_column: str, keys: Sequence[str] = (), strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Distinct gaps between consecutive rows of each series and how often each occurs.

    Repeated times are counted first: a time that holds many rows is one row with that
    many, less one, gaps of zero seconds.
    """
    by = key_columns(keys)
    times = df.where(col(datetime_column).isNotNull()).groupBy(*by, col(datetime_column)).agg(F.count(F.lit(1)).alias("__n"))
    stepped = deltas(times, datetime_column, keys, (), strategy, bands)
    gaps = F.array(
        F.struct(F.col("delta_seconds"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(0.0).alias("delta_seconds"), (F.col("__n") - 1).alias("n")),
    )
    rows = stepped.select(*by, F.inline(gaps).alias("delta_seconds", "n"))
    found = rows.where(F.col("delta_seconds").isNotNull() & (F.col("n") > 0))
    return found.groupBy(*by, "delta_seconds").agg(F.sum("n").alias("n"))


def frequency_gaps(df: DataFrame, datetime_column: str, keys: Sequence[str] = (), strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Gaps between rows that differ from the most common gap (the smallest one on ties)."""
    counted = gap_lengths(df, datetime_column, keys, strategy, bands)
    mode = F.max_by("delta_seconds", F.struct(F.col("n"), -F.col("delta_seconds")))
    total, common = F.sum("n"), F.max("n")
    return counted.groupBy(*key_columns(keys)).agg(
        mode.alias("mode_seconds"),
        total.alias("intervals"),
        (total - common).alias("frequency_gaps"),
        F.round(percent(total - common, total), 2).alias("frequency_gap_pct"),
    )


def holdout_split(df: DataFrame, order_by: Order, keys: Sequence[str] = (), train_fraction: float = 0.8, strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Add ``is_train``: the first ``int(fraction * n)`` rows of each series by time."""
    indexed = sequence(df, order_by, keys, strategy, bands).with_index("__idx", "__total")
    is_train = F.col("__idx") < F.floor(F.col("__total") * F.lit(float(train_fraction)))
    return indexed.withColumn("is_train", is_train).drop("__idx", "__total")


def autocorrelation(df: DataFrame, target: str, order_by: Order, lag_values: Sequence[int], keys: Sequence[str] = (), strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Full-sample autocorrelation of the de-meaned non-null values at each lag.

    One ordered pass: every row meets the rows ``lag`` before it through frame
    lookback, so nothing is exploded or joined with itself. One row per key with
    the row count and the map ``acf`` from lag to value.
    """
    by = key_columns(keys)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    values = df.select(*by, *[col(c) for c in order], col(target).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    means = values.groupBy(*by).agg(F.avg("__x").alias("__mean"))
    centred = attach(values, means, keys, ["__mean"]).withColumn("__x", F.col("__x") - F.col("__mean")).drop("__mean")
    ordered = sequence(centred, order, keys, strategy, bands)
    if len(lag_values) > MAX_LAG_COLUMNS:
        scanned = _autocorrelation_scan(ordered, by, max(lag_values))

        def at(lag: Column) -> Column:
            """Like a lag column: lags beyond the series sum to zero."""
            found = F.get(F.filter("acf", lambda a: a["lag"] == lag), F.lit(0))["acf"]
            return F.struct(lag.cast("int").alias("lag"), F.coalesce(found, F.when(F.col("__power") > 0, 0.0)).alias("acf"))

        return scanned.select(*by, "n", F.transform(F.lit(list(lag_values)), at).alias("acf"))
    made = {f"__l{k}": lag_feature("__x", k) for k in lag_values}
    rows = ordered.over(made, lookback=max(lag_values))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("__x") * F.col("__x")).alias("__power"),
        *[F.sum(F.col("__x") * F.col(f"__l{k}")).alias(f"__s{k}") for k in lag_values],
    )
    scale = F.nullif(F.col("__power"), F.lit(0.0))
    pairs = [F.struct(F.lit(k).alias("lag"), (F.coalesce(F.col(f"__s{k}"), F.lit(0.0)) / scale).alias("acf")) for k in lag_values]
    return sums.select(*by, "n", F.array(*pairs).alias("acf"))


def _autocorrelation_scan(ordered, by: list[Column], longest: int) -> DataFrame:
    """All lags up to ``longest`` at once.

    Each row meets an array of the rows before it; the products are summed per lag
    before the shuffle, so only one row per key, lag and task leaves a task.
    """

    def products(w):
        frame = F.collect_list("__x").over(w.rowsBetween(-longest, 0))
        return F.transform(F.reverse(frame), lambda earlier: earlier * F.col("__x"))

    rows = ordered.over({"__products": products}, lookback=longest)
    per_lag = (
        rows.select(*by, F.posexplode("__products").alias("lag", "__product"))
        .groupBy(*by, "lag")
        .agg(F.sum("__product").alias("__s"), F.count(F.lit(1)).alias("__n"))
    )
    collected = per_lag.groupBy(*by).agg(
        F.max("__n").alias("n"),
        F.max(F.when(F.col("lag") == 0, F.col("__s"))).alias("__power"),
        F.array_sort(F.collect_list(F.struct("lag", "__s"))).alias("__sums"),
    )
    scale = F.nullif(F.col("__power"), F.lit(0.0))
    return collected.select(
        *by,
        "n",
        "__power",
        F.transform("__sums", lambda s: F.struct(s["lag"].alias("lag"), (s["__s"] / scale).alias("acf"))).alias("acf"),
    )


def seasonality(df: DataFrame, target: str, order_by: Order, frequency: str | None = None, keys: Sequence[str] = (), strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Per key ``has_seasonality`` and ``seasonality_period``.

    First passing candidate lag of the frequency, else the first passing lag from 2 up to
    ``min(n / 2, 365)``. Only series without a passing candidate are scanned at all lags.
    """
    by = key_columns(keys)
    code = parse_frequency(frequency) if frequency else parse_frequency("D")
    candidates = SEASONAL_LAGS.get(code.unit, (7, 14, 30, 365) if not frequency else ())
    longest = F.least(F.floor(F.col("n") / 2).cast("int"), F.lit(MAX_SCANNED_LAG))
    usable = (F.col("n") >= MIN_SEASONAL_ROWS) & (longest >= 7)

    def first_passing(limit: Column) -> Column:
        passing = F.filter("acf", lambda a: (a["acf"] > ACF_THRESHOLD) & (a["lag"] < limit))
        return F.when(usable, F.get(passing, F.lit(0))["lag"])

    if candidates:
        tested = autocorrelation(df, target, order_by, candidates, keys, strategy, bands).select(
            *by, "n", first_passing(F.col("n")).alias("__candidate")
        )
    else:
        tested = df.where(col(target).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("__candidate", F.lit(None).cast("int"))
    open_keys = tested.where(F.col("__candidate").isNull())
    if keys:
        rest = attach(df, open_keys.withColumn("__open", F.lit(True)), keys, ["__open"]).where("__open")
    else:
        rest = df.where(open_keys.agg(F.count(F.lit(1)).alias("n")).scalar() > 0)
    scanned = autocorrelation(rest.select(*df.columns), target, order_by, range(2, MAX_SCANNED_LAG), keys, strategy, bands).select(
        *by, first_passing(longest).alias("__scanned")
    )
    both = attach(tested, scanned, keys, ["__scanned"])
    period = F.coalesce("__candidate", "__scanned").cast("int")
    return both.select(*by, period.isNotNull().alias("has_seasonality"), period.alias("seasonality_period"))


def sign_sum(values: np.ndarray) -> int:
    """Sum of sign(later - earlier) over all pairs of an array, by merging sorted halves."""
    n, size = len(values), 64
    padded = np.concatenate([values, np.full(-n % size, np.nan)]).reshape(-1, size)
    total = 0
    for block in padded:
        block = block[~np.isnan(block)]
        total += int(np.sign(np.triu(block[None, :] - block[:, None], 1)).sum())
    merged = [np.sort(b[~np.isnan(b)]) for b in padded]
    while len(merged) > 1:
        after = []
        for left, right in zip(merged[::2], merged[1::2]):
            below, above = np.searchsorted(left, right, "left"), np.searchsorted(left, right, "right")
            total += int(below.sum()) - int((len(left) - above).sum())
            after.append(np.sort(np.concatenate([left, right]), kind="stable"))
        merged = after + merged[len(after) * 2 :]
    return total


def trend_concordance(df: DataFrame, target: str, order_by: Order, keys: Sequence[str] = (), strategy: str = "banded", bands: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Kendall-type sign agreement over all pairs of values of each series.

    The rows are cut into runs of ``cell_rows`` by time and into runs by value. Pairs inside a
    time run are counted in its task. Pairs of different time and value runs follow from the
    row counts of the cells that the runs form. Pairs of different time runs that share a
    value run are those of the value run less those of its cells. A value that many rows have
    is a value run of its own, whose pairs sum to zero, so no task holds more than a run.
    """
    by = key_columns(keys)
    number = col(target).cast("double")
    values = df.where(number.isNotNull() & ~F.isnan(number))
    placed = sequence(values, order_by, keys, strategy, bands).with_index("__idx", "__n").select(*by, "__idx", "__n", number.alias("__v"))
    distinct = placed.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__same"))
    ranked = sequence(distinct, "__v", keys, strategy, bands).running_total("__same", "__cum")
    first = F.floor((F.col("__cum") - F.col("__same")) / cell_rows) * 2
    runs = ranked.select(*by, "__v", (first + (F.col("__same") > cell_rows).cast("long")).alias("__value_run"))
    rows = attach(placed.withColumn("__time_run", F.floor(F.col("__idx") / cell_rows)), runs, [*keys, "__v"], ["__value_run"])
    fields = [T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    schema = T.StructType([*fields, T.StructField("s", T.DoubleType())])
    narrow = rows.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], "__idx", "__v", "__time_run", "__value_run")
    names = [f"k{i}" for i in range(len(keys))]

    def summed(total: Callable[[pd.DataFrame], float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{k: pdf[k].iloc[:1].tolist() for k in names}, "s": [float(total(pdf))]})

        return run

    def in_time_run(pdf: pd.DataFrame) -> float:
        return sign_sum(pdf.sort_values("__idx")["__v"].to_numpy())

    def in_value_run(pdf: pd.DataFrame) -> float:
        ordered = pdf.sort_values("__idx")
        cells = sum(sign_sum(part.to_numpy()) for _, part in ordered.groupby("__time_run", sort=False)["__v"])
        return sign_sum(ordered["__v"].to_numpy()) - cells

    def between_cells(pdf: pd.DataFrame) -> float:
        _, place = np.unique(pdf["__value_run"], return_inverse=True)
        seen, total = np.zeros(place.max() + 1), 0.0
        for _, part in pdf.assign(place=place).sort_values("__time_run").groupby("__time_run", sort=True):
            below = np.concatenate([[0.0], np.cumsum(seen)])
            at, n = part["place"].to_numpy(), part["n"].to_numpy(float)
            total += float((n * (below[at] - (below[-1] - below[at + 1]))).sum())
            np.add.at(seen, at, n)
        return total

    counts = narrow.groupBy(*names, "__time_run", "__value_run").agg(F.count(F.lit(1)).alias("n"))
    even = narrow.where(F.col("__value_run") % 2 == 0)
    parts = (
        narrow.groupBy(*names, "__time_run").applyInPandas(summed(in_time_run), schema)
        .unionByName(even.groupBy(*names, "__value_run").applyInPandas(summed(in_value_run), schema))
        .unionByName((counts.groupBy(*names) if names else counts.groupBy(F.lit(1))).applyInPandas(summed(between_cells), schema))
    )
    agreed = parts.groupBy(*names).agg(F.sum("s").alias("__s"))
    renamed = agreed.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "__s")
    sizes = placed.groupBy(*by).agg(F.max("__n").alias("n"))
    both = attach(sizes, renamed, keys, ["__s"])
    pairs = F.nullif(F.col("n") * (F.col("n").cast("double") - 1) / 2.0, F.lit(0.0))
    statistic = F.when(F.col("n") >= MIN_TREND_ROWS, F.col("__s") / pairs)
    return both.select(
        *by, "n", statistic.alias("concordance"),
        F.coalesce(F.abs(statistic) > TREND_THRESHOLD, F.lit(False)).alias("has_trend"),
    )


def ewm_alpha(alpha: float | None = None, span: float | None = None) -> float:
    if (alpha is None) == (span is None):
        raise ValueError("give either alpha or span")
    value = alpha if alpha is not None else 2.0 / (span + 1.0)
    if not 0 < value <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    return value


def ewm_mean(df: DataFrame, target: str, order_by: Order, keys: Sequence[str] = (), alpha: float | None = None, span: float | None = None, output: str = "ewm_mean", strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Recursive exponentially weighted mean: first value, then ``a * x + (1 - a) * previous``.

    Nulls carry no weight and keep the level before them, however many follow each other.
    The step is affine in the level before it, so the values of a series are cut into blocks
    so long that a level from two blocks back is below the resolution of a double: each block
    is one running sum, and one level per block is carried into the next.
    """
    a = ewm_alpha(alpha, span)
    block = 1 if a == 1 else max(1, math.floor(100 * math.log(10) / -math.log(1 - a)))
    by = key_columns(keys)
    present = df.withColumn("__w", col(target).isNotNull().cast("long"))
    counted = sequence(present, order_by, keys, strategy, bands).running_total("__w", "__k").drop("__w")
    k = F.col("__k") - 1
    values = counted.where(col(target).isNotNull()).select(
        *by, "__k", F.floor(k / block).alias("__block"), F.pmod(k, F.lit(block)).alias("__at"), col(target).cast("double").alias("__x")
    )
    weight = F.when(F.col("__k") == 1, F.lit(1.0)).otherwise(F.lit(a))
    scaled = weight * F.col("__x") * F.pow(F.lit(1 - a), -F.col("__at"))
    group = Window.partitionBy(*by, "__block").orderBy("__at")
    inside = F.sum(scaled).over(group) * F.pow(F.lit(1 - a), F.col("__at")) if a < 1 else F.col("__x")
    levels = values.withColumns({"__level": inside})
    ends = levels.groupBy(*by, "__block").agg(F.max_by("__level", "__at").alias("__end"))
    carried = ends.withColumn("__block", F.col("__block") + 1)
    joined = attach(levels, carried, [*keys, "__block"], ["__end"])
    whole = F.col("__level") + F.coalesce(F.col("__end"), F.lit(0.0)) * F.pow(F.lit(1 - a), F.col("__at") + 1)
    found = joined.select(*by, "__k", whole.alias(output))
    return attach(counted, found, [*keys, "__k"], [output]).drop("__k")


def ewm_level(df: DataFrame, target: str, order_by: Order, keys: Sequence[str] = (), alpha: float | None = None, span: float | None = None, strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Last level of the same recursion per series, as one weighted sum over all rows."""
    a = ewm_alpha(alpha, span)
    values = df.where(col(target).isNotNull())
    indexed = sequence(values, order_by, keys, strategy, bands).with_index("__idx", "__total")
    age = F.col("__total") - 1 - F.col("__idx")
    weight = F.when(F.col("__idx") == 0, F.lit(1.0)).otherwise(F.lit(a)) * F.pow(F.lit(1 - a), age)
    return indexed.groupBy(*key_columns(keys)).agg(F.sum(weight * col(target).cast("double")).alias("level"))


def residual_autocorrelation(df: DataFrame, residual: str, order_by: Order, keys: Sequence[str] = (), strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Lag-1 Pearson of the residuals; 0 for a single row, null when undefined."""
    made = {"__before": lag_feature(residual, 1)}
    rows = sequence(df, order_by, keys, strategy, bands).over(made, lookback=1)
    value = F.when(F.count(F.lit(1)) > 1, correlation(col(residual), F.col("__before"))).otherwise(F.lit(0.0))
    return rows.groupBy(*key_columns(keys)).agg(value.alias("autocorr_lag1"))


def residual_trend(df: DataFrame, residual: str, order_by: Order, keys: Sequence[str] = (), strategy: str = "banded", bands: int | None = None) -> DataFrame:
    """Slope of the residuals on the row number; a trend if above a tenth of their deviation."""
    rows = sequence(df, order_by, keys, strategy, bands).with_index("__idx")
    slope = F.regr_slope(col(residual), F.col("__idx").cast("double"))
    flagged = (F.count(F.lit(1)) >= 10) & (F.abs(slope) > 0.1 * F.stddev_pop(col(residual)))
    return rows.groupBy(*key_columns(keys)).agg(
        slope.alias("slope"), F.coalesce(flagged, F.lit(False)).alias("has_trend")
    )


