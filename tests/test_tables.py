"""Edge cases of table operators on small hand-made frames."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import numeric_columns, parse_bound, quoted_table
from tidemark.functions.frequency import Frequency, bucket_start, frequency_code, parse_frequency
from tidemark.operators import aggregate as agg
from tidemark.operators import fill
from tidemark.operators import join as joins
from tidemark.operators import project as prj
from tidemark.operators.prepare import apply_linked, execute_operation, register_operation
from tidemark.operators.stats import quantiles


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_sort_puts_nulls_first_both_ways(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert values(prj.sort_rows(df, "v"), "v") == [(None,), (1,), (2,)]
    assert values(prj.sort_rows(df, "v", ascending=False), "v") == [(None,), (2,), (1,)]


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (3.0,)], "v double")
    assert values(prj.clip_negative(df, "v"), "v") == [(0.0,), (None,), (3.0,)]


def test_normalize_constant_column_is_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    for method in ("min_max", "z_score"):
        assert values(prj.normalize(df, "v", method, "n"), "n") == [(0.0,)] * 3
    one = spark.createDataFrame([(5.0,)], "v double")
    assert values(prj.normalize(one, "v", "z_score", "n"), "n") == [(0.0,)]


def test_filter_casts_text_to_the_column_type(spark):
    df = spark.createDataFrame([(1, "a", date(2024, 1, 1)), (None, "b", None), (3, "1", date(2024, 2, 1))], "n int, s string, d date")
    assert values(prj.filter_rows(df, "n", ">=", "2"), "n") == [(3,)]
    assert values(prj.filter_rows(df, "n", "<", "2.5"), "n") == [(1,)]
    assert values(prj.filter_rows(df, "s", "==", 1), "s") == [("1",)]
    assert values(prj.filter_rows(df, "d", ">", "2024-01-15"), "n") == [(3,)]
    with pytest.raises(ValueError):
        prj.filter_rows(df, "n", "~", 1)


def test_date_range_is_inclusive_and_rounds_inwards_for_dates(spark):
    df = spark.createDataFrame([(date(2024, 1, i),) for i in range(1, 6)], "d date")
    kept = prj.filter_date_range(df, "2024-01-02", "2024-01-04")
    assert [d.day for (d,) in values(kept, "d")] == [2, 3, 4]
    kept = prj.filter_date_range(df, "2024-01-02T10:00:00Z", "2024-01-04T10:00:00Z")
    assert [d.day for (d,) in values(kept, "d")] == [3, 4]
    assert prj.filter_date_range(df).count() == 5
    assert parse_bound("2024-01-02T10:00:00+02:00") == datetime(2024, 1, 2, 8)
    with pytest.raises(ValueError):
        prj.filter_date_range(df.select(F.lit(1).alias("x")), "2024-01-02")


def test_date_filter_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = prj.filter_date_range(events, "2024-01-05", "2024-01-06", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    plan = prj.filter_rows(events, "value", ">", "10")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,10.0)" in plan


def test_combine_datetime_null_and_garbage(spark):
    df = spark.createDataFrame([("2024-01-01", "10:15"), (None, "10:15"), ("2024-01-01", "noon")], "d string, t string")
    got = values(prj.combine_datetime(df, "d", "t"), "datetime")
    assert got == [(datetime(2024, 1, 1, 10, 15),), (None,), (None,)]
    assert prj.combine_datetime(df, "d", "t", "d", drop_original=True).columns == ["d"]


def test_drop_missing_forms(spark):
    df = spark.createDataFrame([(1, 1, None), (None, None, 1), (1, 1, 1)], "a int, b int, c int")
    assert prj.drop_missing(df).count() == 1
    assert prj.drop_missing(df, "a").count() == 2
    assert prj.drop_missing(df, min_non_null=2).count() == 2
    assert prj.drop_missing(df, min_fraction=0.5).count() == 3
    assert prj.drop_missing(df, min_fraction=0.7).count() == 2


def test_outliers_need_enough_values_and_width(spark):
    short = spark.createDataFrame([(float(i),) for i in range(9)] + [(1000.0,)], "v double")
    assert prj.handle_outliers(short, "v", "remove").count() == 10
    flat = spark.createDataFrame([(1.0,)] * 20 + [(500.0,)], "v double")
    assert prj.handle_outliers(flat, "v", "clip").agg(F.max("v")).first()[0] == 500.0
    wide = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,)], "v double")
    assert prj.handle_outliers(wide, "v", "remove").count() == 20
    clipped = prj.handle_outliers(wide, "v", "clip")
    assert clipped.count() == 22 and clipped.agg(F.max("v")).first()[0] < 100
    assert clipped.where("v is null").count() == 1


@pytest.mark.parametrize("strategy", ["keyed", "banded"])
@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_exact_quantiles_both_ways(spark, strategy, n):
    import numpy as np

    rows = [(k, float((i * 7) % 13)) for k in "ab" for i in range(n)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["q1"], r["q9"]) for r in quantiles(df, "v", {"q1": 0.25, "q9": 0.9}, ["k"], strategy=strategy).collect()}
    v = [float((i * 7) % 13) for i in range(n)]
    want = tuple(np.quantile(v, [0.25, 0.9]))
    assert set(got) == {"a", "b"}
    for k in got:
        assert got[k] == pytest.approx(want)


@pytest.mark.parametrize("strategy", ["keyed", "banded"])
def test_weighted_quantiles(spark, strategy):
    import numpy as np

    df = spark.createDataFrame([(0.0, 50), (3.0, 2), (9.0, 7), (20.0, 1)], "v double, n int")
    got = quantiles(df, "v", {"a": 0.5, "b": 0.85, "c": 0.9, "d": 1.0}, strategy=strategy, weight="n").first()
    v = np.repeat([0.0, 3.0, 9.0, 20.0], [50, 2, 7, 1])
    assert tuple(got) == pytest.approx(tuple(np.quantile(v, [0.5, 0.85, 0.9, 1.0])))


def test_hot_value_is_one_row_of_the_quantile_sort(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).cast("double").alias("v"))
    a = quantiles(df, "v", {"m": 0.5, "q": 0.9}, strategy="banded").first()
    assert tuple(a) == pytest.approx(tuple(quantiles(df, "v", {"m": 0.5, "q": 0.9}, strategy="keyed").first()))


def test_repeated_times_count_as_zero_gaps(spark):
    from tidemark.operators.series import frequency_gaps

    times = [datetime(2024, 1, 1)] * 4 + [datetime(2024, 1, 2), datetime(2024, 1, 3)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    row = frequency_gaps(df, "ts").first()
    assert (row["mode_seconds"], row["intervals"], row["frequency_gaps"]) == (0.0, 5, 2)


def test_describe_both_ways_agree(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)] + [(50, None)], "a int, b double")
    assert sorted(agg.describe(df, strategy="keyed").collect()) == sorted(agg.describe(df, strategy="banded").collect())


def test_empty_table_statistics(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz, k string, v double")
    stats = agg.target_stats(df, "v").first()
    assert stats["count"] == 0 and stats["missing_pct"] == 0.0
    assert agg.duplicate_count(df, "ts").first()[0] == 0
    assert agg.iqr_outliers(df, "v").first()["outliers"] == 0
    assert agg.group_stats(df, ["k"]).first()["n_groups"] == 0
    assert agg.missing_summary(df).count() == 3
    assert agg.resample(df, "ts", "D", "sum", "v").count() == 0
    assert fill.fill_missing(df, "v", "ffill", "ts").count() == 0


def test_resample_keeps_totals_and_skips_empty_buckets(spark):
    rows = [(datetime(2024, 1, d, h), float(h)) for d in (1, 2, 9) for h in (0, 5, 23)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    daily = agg.resample(df, "ts", "D", "sum", "v")
    assert daily.count() == 3
    assert daily.agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]
    first = agg.resample(df, "ts", "W", "first", "v").orderBy("ts").collect()
    assert [r["ts"] for r in first] == [datetime(2024, 1, 1), datetime(2024, 1, 8)]
    assert agg.resample(df, "ts", "W").columns == ["ts", "v"]
    with pytest.raises(ValueError):
        agg.resample(df.select("ts"), "ts")


def test_resample_runs_on_streaming_input(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    path = str(tmp_path / "in")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = agg.resample(stream, "ts", "6H", "sum", "value").writeStream.outputMode("complete").format("memory").queryName("resampled").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("resampled").agg(F.round(F.sum("value"), 4), F.count("*")).first()
    want = agg.resample(events, "ts", "6H", "sum", "value").agg(F.round(F.sum("value"), 4), F.count("*")).first()
    assert tuple(got) == tuple(want)


@pytest.mark.parametrize(
    "code,want",
    [("D", (1, "day")), ("h", (1, "hour")), ("15min", (15, "minute")), ("15m", (15, "minute")), ("3M", (3, "month")),
     ("30s", (30, "second")), ("MS", (1, "month")), ("weird?", (1, "day")), (None, (1, "day")), ("2W", (2, "week"))],
)
def test_frequency_codes(code, want):
    assert parse_frequency(code) == Frequency(*want)


def test_bucket_alignment(spark):
    df = spark.createDataFrame([(datetime(2024, 5, 15, 13, 47, 31),)], "t timestamp_ntz")
    got = df.select(*[bucket_start(F.col("t"), f).alias(f"x{i}") for i, f in enumerate(["W", "15min", "2H", "3MO", "Q", "Y", "2W"])]).first()
    assert tuple(got)[:6] == (
        datetime(2024, 5, 13), datetime(2024, 5, 15, 13, 45), datetime(2024, 5, 15, 12), datetime(2024, 4, 1),
        datetime(2024, 4, 1), datetime(2024, 1, 1),
    )
    assert got[6].weekday() == 0
    with pytest.raises(ValueError):
        agg.pre_aggregate(df.withColumn("v", F.lit(1)), "t", ["v"], frequency="15min")


@pytest.mark.parametrize(
    "seconds,code",
    [(60, "T"), (66, "66s"), (3600, "H"), (86400 + 1700, "D"), (7 * 86400, "W"), (30 * 86400, "M"), (181.5, "181s"), (0, None), (None, None)],
)
def test_frequency_labels(spark, seconds, code):
    df = spark.createDataFrame([(None if seconds is None else float(seconds),)], "s double")
    assert df.select(frequency_code(F.col("s"))).first()[0] == code


def test_interpolate_leaves_the_ends(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, None), (5, 4.0), (6, None)], "i int, v double")
    got = values(fill.fill_missing(df, "v", "interpolate", "i").orderBy("i"), "v")
    assert got == [(None,), (1.0,), (2.0,), (3.0,), (4.0,), (None,)]


def test_fill_all_columns_and_errors(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 2.0, None), (3, None, None)], "i int, v double, s string")
    got = values(fill.fill_missing(df, "__all__", "ffill", "i").orderBy("i"), "v", "s")
    assert got == [(None, "x"), (2.0, "x"), (2.0, "x")]
    assert values(fill.fill_missing(df, "__all__", "mean", "i").orderBy("i"), "v", "s")[2] == (2.0, None)
    assert values(fill.fill_missing(df, "v", 7).orderBy("i"), "v")[0] == (7.0,)
    for bad in ({"method": "magic"}, {"method": "value"}, {"method": "ffill"}):
        with pytest.raises(ValueError):
            fill.fill_missing(df, "v", **bad)


def test_fix_frequency_fills_the_grid_per_series(spark):
    rows = [("a", datetime(2024, 1, 1), 1.0), ("a", datetime(2024, 1, 4), 4.0), ("b", datetime(2024, 1, 2), 9.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    filled = fill.fix_frequency(df, "ts", "D", ["k"]).orderBy("k", "ts")
    assert values(filled, "k", "v") == [("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 9.0)]
    line = fill.fix_frequency(df, "ts", "D", ["k"], "resample_interpolate").orderBy("k", "ts")
    assert values(line, "v")[:4] == [(1.0,), (2.0,), (3.0,), (4.0,)]
    months = spark.createDataFrame([(datetime(2024, 1, 1), 1.0), (datetime(2024, 4, 1), 4.0)], "ts timestamp_ntz, v double")
    assert fill.fix_frequency(months, "ts", "MS").count() == 4


def test_join_overlap_and_holidays(spark):
    mine = spark.createDataFrame([(date(2024, 1, i), i) for i in (1, 2, 3, 4)] + [(None, 0)], "d date, i int")
    other = spark.createDataFrame([("2024-01-02", 5.0), ("2024-01-09", 6.0), ("n/a", 7.0)], "date string, x double")
    overlap = joins.date_overlap(mine, "d", other, "date").first()
    assert (overlap["n_dates"], overlap["n_common"], overlap["overlap_pct"], overlap["accepted"]) == (4, 1, 25.0, True)
    joined = joins.join_external(mine, other, "d", "date")
    assert joined.count() == 5 and joined.where("x = 5.0").count() == 1 and "date" not in joined.columns
    flags = values(joins.holiday_flag(mine, "d", other).orderBy("i"), "is_holiday")
    assert flags == [(None,), (0,), (1,), (0,), (0,)]
    assert values(joins.holiday_flag(mine, "d"), "is_holiday") == [(0,)] * 5
    far = spark.createDataFrame([("2030-01-01", 1.0)], "date string, x double")
    ranked = joins.rank_joins(mine, "d", {"other": (other, "date"), "far": (far, "date")})
    assert values(ranked, "table_name", "confidence") == [("other", 0.25)]


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    assert sorted(values(agg.aggregate(df, "k", "v", "sum"), "k", "v"), key=str) == [("a", 5.0), (None, 4.0)]
    spread = prj.normalize(df, "v", "min_max", "n", ["k"]).orderBy("v")
    assert values(spread, "n") == [(0.0,), (1.0,), (0.0,)]


def test_keep_last_handles_a_hot_timestamp(spark):
    df = spark.range(5000).select(F.lit(datetime(2024, 1, 1)).alias("ts"), "id", (F.col("id") * 2).alias("v"))
    got = agg.keep_last(df, "ts", "id")
    assert values(got, "id", "v") == [(4999, 9998)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan


def test_dispatcher_reports_errors(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, v double")
    assert not execute_operation(df, "nope", {}).success
    missing = execute_operation(df, "fill_missing", {"columns": "v", "value_column": "zzz"})
    assert not missing.success and "zzz" in missing.message
    assert not execute_operation(df, "add_column", {"column_name": "x", "expression": "a +"}).success
    assert execute_operation(df, "rename_column", {"old_name": "a", "new_name": "b"}).df.columns == ["b", "v"]
    register_operation("double", lambda d, column: d.withColumn(column, F.col(column) * 2))
    assert values(execute_operation(df, "double", {"column": "v"}).df, "v") == [(4.0,)]


def test_linked_tables_without_the_column_are_untouched(spark):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0)], "a int, v double")
    other = spark.createDataFrame([("x",)], "s string")
    main, linked = apply_linked("clip_negative", {"column": "v"}, df, {"same": df, "other": other})
    assert main.where("v < 0").count() == linked["same"].where("v < 0").count() == 0
    assert linked["other"].columns == ["s"]


def test_roles_and_identifiers(spark):
    df = spark.createDataFrame([], "ds string, t timestamp, y double, x int, index int, name string")
    assert numeric_columns(df, {"t", "y"}) == ["x", "index"]
    assert quoted_table("shop.sales") == '"shop"."sales"'
    for bad in ("a;b", "1x", 'a"b', "a.b.c"):
        with pytest.raises(ValueError):
            quoted_table(bad)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in agg.correlation_matrix(df).collect()}
    assert got[("a", "b")] is None and got[("b", "b")] == pytest.approx(1.0)
    assert agg.correlation_with(df, "a").first()["abs_corr"] is None
    flat = spark.createDataFrame([(5.0,)] * 6, "v double")
    assert agg.skewness(flat, "v").first()[0] == 0.0
    assert agg.zscore_outliers(flat, "v").first()["outliers_count"] == 0
    assert agg.iqr_outliers(flat, "v").first()["outliers"] == 0
