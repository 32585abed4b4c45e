"""Hard negatives and vector codes against brute force in plain Python, and awkward tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn
from tidemark.llm import vector_codes as vc
from tidemark.llm.common import table
from tidemark.llm.queries import op12_hard_negatives, op13_vector_codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def random_rows(seed, n, width=12, labels=3, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, width)], int(rng.integers(labels))) for i in range(n)]


BAD = [(900, None, 1), (901, [1.0, None, 2.0], 1), (902, [NAN, 1.0], 2), (903, [INF, 1.0], 0)]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


# ---- hard negatives


def mined(rows, is_anchor=lambda i: i % 50 == 0, positives=5, negatives=3):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in usable(rows) if i is not None and lab is not None]
    out = []
    for n, (i, q, lab) in enumerate(kept):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=False)), j, k) for m, (j, p, k) in enumerate(kept) if m != n)
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            inside = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(inside, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    base = random_rows(1, 260, labels=3)
    rows = [*base, *[(500 + i, base[i][1], (base[i][2] + i) % 3) for i in range(40)], *BAD, (904, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    rows += [(1000, [0.0] * 12, 1), (1050, [-1.0] * 12, 2), (1100, [0.5], 0), (1150, [], 1), (100, base[100][1], base[100][2])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("anchor", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("score", F.lit(None))
    got = sorted(tuple(r) for r in hn.mine(df).collect())
    assert got == mined(rows) and len(got) > 50


def test_hard_negatives_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS_A_BLOCK", 3)
    monkeypatch.setattr(hn, "LEAST_ROWS", 20)
    rows = random_rows(2, 200, width=20, labels=2)
    got = hn.mine(spark.createDataFrame(rows, SCHEMA), is_anchor=F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, lambda i: i % 10 == 0)


def test_hard_negatives_with_ties_and_one_hot_label(spark):
    rows = [(i, [float(i % 3 + 1), 1.0, 0.0], 0 if i % 3 else i % 7) for i in range(160)]
    got = hn.mine(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)


@pytest.mark.parametrize("rows", [[], BAD, [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(1, [1.0], 1), (2, [0.7], 2)]])
def test_hard_negatives_without_any(spark, rows):
    assert hn.mine(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("spread", [0.05, 1.0, 30.0])
def test_threshold_pairs_are_whole(spread):
    rng = np.random.default_rng(4)
    x, y = (np.floor(256 * rng.normal(0, spread, (n, 27))) for n in (30, 300))
    y[5], y[6], x[0] = 0, y[7], 0
    exact = (x @ y.T).astype(np.int64)
    for q in (0.0, 0.5, 0.9, 0.99, 1.0):
        least = np.quantile(exact, q, axis=1).round()
        i, j, s = hn.pairs_at_least(x, y, least)
        want = np.argwhere(exact >= least[:, None])
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(w) for w in want.tolist()]
        assert (exact[i, j] == s).all()


def test_index_omits_what_norms_cover():
    """With a high threshold only the rows that can reach it are multiplied out."""
    y = np.zeros((50, 16))
    y[:, 8:] = 1
    y[:5, 0] = 1000
    i, j, _ = hn.pairs_at_least(y[:1], y, np.array([500_000.0]))
    assert sorted(j.tolist()) == [0, 1, 2, 3, 4] and set(i.tolist()) == {0}


def test_hard_negative_query_changes_labels_of_sevens(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table(spark, SF, "embeddings").collect()]
    assert sorted(tuple(r) for r in op12_hard_negatives(spark, SF).collect()) == mined(rows)


# ---- vector codes


def coded(rows, entries=16, rounds=6):
    """One row at a time, all distances of all entries."""
    kept = sorted(((i, v, lab) for i, v, lab in usable(rows)), key=lambda r: (r[0] is None, r[0], [math.floor(4096 * x) for x in r[1]]))
    width = len(kept[0][1])
    edges = vc.part_edges(width)
    parts = [[[math.floor(4096 * x) for x in v[a:b]] for a, b in zip(edges, edges[1:], strict=False)] for _, v, _ in kept if len(v) == width]
    books = [[p[k] for p in parts[:entries]] for k in range(8)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    pick = lambda k, p: min((far(p[k], e), n) for n, e in enumerate(books[k]))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for p in parts:
            for k in range(8):
                held[k][pick(k, p)[1]].append(p[k])
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(held[k], books[k], strict=True)] for k in range(8)]
    found = [[pick(k, p) for k in range(8)] for p in parts]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), lab) for (i, _, lab), f in zip([r for r in kept if len(r[1]) == width], found, strict=True)]
    return [(i, c, e, sum(x[2] for x in out if x[3] == lab)) for i, c, e, lab in out], digest


def result(df, **how):
    made, books = vc.compress(df, **how)
    return made.collect(), books.sha256()


def rows_like(got):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str)


@pytest.mark.parametrize("width", [64, 8, 19, 5])
def test_codes_equal_brute_force(spark, width):
    rows = random_rows(width, 130, width, 4)
    rows += [(200 + i, rows[i][1], None) for i in range(25)] + [(3, rows[9][1], 2), (None, rows[4][1], 1), (300, [0.0] * width, 1), (301, [1.0] * width, 1)] + BAD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("q", F.lit(1)).repartition(5)
    got, digest = result(df)
    want, sha = coded(rows)
    assert rows_like(got) == sorted(want, key=str) and digest == sha
    assert all(1 <= r["evaluations"] <= 8 * 16 for r in got)


def test_bounds_prune_but_keep_ties():
    rng = np.random.default_rng(8)
    centers = rng.integers(-20_000, 20_000, (16, 8))
    x = np.concatenate([centers[rng.integers(16, size=400)] + rng.integers(-50, 50, (400, 8)), centers, (centers[:8] + centers[8:]) // 2])
    entries = np.concatenate([centers[:12], centers[:4]])
    pivots = vc.spread_pivots(entries)
    far = np.sqrt(vc.squares(x, pivots).astype(float)).astype(np.float32)
    at, best, done = vc.nearest(x, entries, far, pivots)
    exact = vc.squares(x, entries)
    assert (at == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert done.mean() < 8


def test_few_equal_or_no_rows(spark):
    for rows in ([], BAD):
        assert result(spark.createDataFrame(rows, SCHEMA))[0] == []
    rows = [(5, [0.25] * 16, 1), (5, [0.25] * 16, 1), (6, [-0.25] * 16, None)]
    got, digest = result(spark.createDataFrame(rows, SCHEMA))
    want, sha = coded(rows)
    assert rows_like(got) == sorted(want, key=str) and digest == sha


def test_rows_that_cannot_be_compared_have_null_codes(spark):
    rows = random_rows(3, 40, 16)
    got, digest = result(spark.createDataFrame([*rows, (90, [1.0, 2.0], 1), (91, [1e30] * 16, 1), (92, [], None)], SCHEMA))
    want, sha = coded(rows)
    assert digest == sha and rows_like(r for r in got if r["code"]) == sorted(want, key=str)
    odd = {r["vec_id"]: r for r in got if r["code"] is None}
    assert set(odd) == {90, 91, 92} and all(r["error"] is None for r in odd.values())


def test_empty_vectors_have_empty_parts(spark):
    got, _ = result(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA))
    assert {(r["vec_id"], r["code"], r["error"]) for r in got} == {(1, "00" * 8, 0), (2, "00" * 8, 0)}


def test_code_query_covers_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    want, sha = coded(rows)
    got = op13_vector_codes(spark, SF).collect()
    assert rows_like(got) == sorted(want, key=str) and {r["codebooks_sha256"] for r in got} == {sha}
