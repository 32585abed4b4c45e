"""Banded and plain evaluation must agree, whatever the bands cut through."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.sequence import BandedSequence, KeyedSequence


def panel(spark, seed, n=600):
    """A hot key with most rows, small keys, a null key, tied times and null values."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        value = None if rng.random() < 0.4 else float(rng.randint(0, 50))
        rows.append((i, key, rng.randint(0, 40), value))
    # a long run of nulls inside the hot key, longer than several bands
    rows = [(i, k, t, None if k == "hot" and 10 <= t <= 25 else v) for i, k, t, v in rows]
    return spark.createDataFrame(rows, "id int, k string, t int, v double")


def same(a, b):
    key = lambda r: r["id"]
    left = sorted([r.asDict() for r in a.collect()], key=key)
    right = sorted([r.asDict() for r in b.collect()], key=key)
    assert len(left) == len(right)
    for x, y in zip(left, right):
        assert x.keys() == y.keys()
        for c in x:
            if isinstance(x[c], float) and isinstance(y[c], float):
                assert x[c] == pytest.approx(y[c], abs=1e-9), (c, x, y)
            else:
                assert x[c] == y[c], (c, x, y)


@pytest.mark.parametrize("bands", [1, 40])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_frames_match_plain_windows(spark, bands, keys):
    df = panel(spark, bands)
    features = {
        "lag_7": lambda w: F.lag("v", 7).over(w),
        "mean_30": lambda w: F.avg("v").over(w.rowsBetween(-29, 0)),
        "lead_9": lambda w: F.lead("v", 9).over(w),
    }
    plain = KeyedSequence(df, ["t", "id"], keys).over(features)
    banded = BandedSequence(df, ["t", "id"], keys, bands).over(features, lookback=29, lookahead=9)
    same(plain, banded)


@pytest.mark.parametrize("bands", [1, 40])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_index_matches_row_number(spark, bands, keys):
    df = panel(spark, bands + 1)
    plain = KeyedSequence(df, ["t", "id"], keys).with_index("i", "n")
    banded = BandedSequence(df, ["t", "id"], keys, bands).with_index("i", "n")
    same(plain, banded)


@pytest.mark.parametrize("bands", [1, 40])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_neighbours_match(spark, bands, keys):
    df = panel(spark, bands + 2)
    pick = ["id", F.col("__prev_0.v").alias("p"), F.col("__next_0.v").alias("n"),
            (F.col("__pos") - F.col("__prev_0.g")).alias("dp")]
    plain = KeyedSequence(df, ["t", "id"], keys).neighbours(["v"]).select(*pick)
    banded = BandedSequence(df, ["t", "id"], keys, bands).neighbours(["v"]).select(*pick)
    same(plain, banded)


@pytest.mark.parametrize("bands", [1, 40])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_running_total_matches(spark, bands, keys):
    df = panel(spark, bands + 3).withColumn("w", F.col("id") % 7)
    plain = KeyedSequence(df, ["t", "id"], keys).running_total("w", "cum")
    same(plain, BandedSequence(df, ["t", "id"], keys, bands).running_total("w", "cum"))


def test_equal_order_still_spreads_over_bands(spark):
    df = spark.range(4000).select(F.lit(1).alias("t"), "id")
    sizes = BandedSequence(df, ["t"], [], 8).rows.groupBy("__band").count()
    assert sizes.agg(F.max("count")).first()[0] < 1500


def test_empty_input(spark):
    df = panel(spark, 5).where("false")
    banded = BandedSequence(df, ["t", "id"], ["k"], 4)
    assert banded.with_index("i", "n").count() == 0
    assert banded.neighbours(["v"]).count() == 0
    assert banded.over({"l": lambda w: F.lag("v").over(w)}, 1).count() == 0


def test_no_row_window_without_partition(spark):
    """Only the one-row-per-band tables may use an unpartitioned window."""
    df = panel(spark, 6)
    out = BandedSequence(df, ["t", "id"], [], 7).over({"l": lambda w: F.lag("v").over(w)}, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [lag(" in plan
    line = next(x for x in plan.splitlines() if "Window [lag(" in x)
    assert "__target" in line
    physical = out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert physical.count("Exchange shufflepartitionidpassthrough") == 1 and "hashpartitioning" not in physical
