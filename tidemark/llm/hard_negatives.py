"""Hard negatives: rows of another label that score a little below an anchor's positives."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import chosen, shuffle_partitions
from tidemark.llm.vector_codes import finite
from tidemark.session import materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: The window of a positive's negatives, in hundredths of its score.
LOW, HIGH = 50, 95
#: Rows and anchors that one task holds at most, and the rows that are worth a task.
ROWS_A_BLOCK, ANCHORS_A_BLOCK, LEAST_ROWS = 65_536, 16_384, 512
#: Scaled components are taken as whole numbers below this size, so that inner products are exact.
LARGEST = 1 << 20
#: Dimensions that are gathered at a time, and anchors.
BAND, SLICE = 8, 64
#: Thresholds of the search for positives, as shares of the largest score that norms allow.
LEVELS = (0.8, 0.6, 0.45, 0.3, 0.15, 0.0)


def suffix_norms(m: np.ndarray) -> np.ndarray:
    """Norm of what follows each band border (rows x bands + 1), rounded up a little."""
    bands = -(-m.shape[1] // BAND)
    squares = np.zeros((len(m), bands + 1))
    for b in range(bands - 1, -1, -1):
        squares[:, b] = squares[:, b + 1] + (m[:, b * BAND : (b + 1) * BAND] ** 2).sum(1)
    return np.sqrt(squares) * (1 + 1e-12)


def pairs_at_least(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, score) of all pairs whose integer inner product is at least ``least`` of the row of x.

    Both hold whole numbers, dimensions in one order. For the lowest threshold
    ``u`` per unit of an anchor's norm, the index leaves out the last dimensions
    of each row of y whose norm is below ``u``: what is left out cannot reach the
    threshold alone. Scores are gathered band by band over the rows that the
    index still has; a pair goes as soon as its score and the product of the
    remaining norms stay below its threshold. What is left is multiplied out.
    """
    none = np.zeros(0, np.int64)
    if not len(x) or not len(y) or not x.shape[1]:
        hit = np.flatnonzero(np.zeros(len(x)) >= least) if len(y) else none
        return np.repeat(hit, len(y)), np.tile(np.arange(len(y)), len(hit)), np.zeros(len(hit) * len(y), np.int64)
    xs, ys = suffix_norms(x), suffix_norms(y)
    unit = least / np.maximum(xs[:, 0], 1e-300)
    u = unit.min()
    bands = xs.shape[1] - 1
    indexed = np.full(len(y), bands) if u <= 0 else (ys[:, :bands] >= u * (1 - 1e-9)).sum(1)
    order = np.argsort(-indexed, kind="stable")
    y, ys, indexed = y[order], ys[order], indexed[order]
    y, ys, order, indexed = (a[: int((indexed > 0).sum())] for a in (y, ys, order, indexed))
    partial = np.zeros((len(x), len(y)))
    seen = 0
    for b in range(bands):
        m = int((indexed > b).sum())
        if not m:
            break
        band = slice(b * BAND, (b + 1) * BAND)
        partial[:, :m] += x[:, band] @ y[:m, band].T
        seen = b + 1
        if b % 3 == 2 and seen < bands:
            left = partial[:, :m] + xs[:, [seen]] * ys[None, :m, seen] >= least[:, None] - 0.5
            if left.mean() < 0.02:
                break
    known = np.minimum(indexed, seen)
    alive = partial + xs[:, known] * ys[np.arange(len(y)), known][None, :] >= least[:, None] - 0.5
    i, j = np.nonzero(alive)
    score = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 16):
        s = slice(k, k + (1 << 16))
        score[s] = np.rint((x[i[s]] * y[j[s]]).sum(1)).astype(np.int64)
    good = score >= least[i]
    return i[good], order[j[good]], score[good]


def firsts(group: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` of each group, higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return order[np.arange(len(g)) - start < count]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of floats, filled up with zeros."""
    flat = column.combine_chunks()
    if (np.diff(flat.offsets.to_numpy()) == width).all():
        return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)
    out = np.zeros((len(column), width))
    for i, v in enumerate(flat):
        w = v.values.to_numpy(zero_copy_only=False)
        out[i, : len(w)] = w
    return out


def _cell(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Vectors of both sides, dimensions with the largest squares first, and their other columns."""
    width = max((int(np.diff(t.column("q").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (rows, anchors)), default=0)
    y, x = _matrix(rows.column("q"), width), _matrix(anchors.column("q"), width)
    order = np.argsort(-(y**2).sum(0), kind="stable")
    plain = lambda t: {c: t.column(c).to_numpy() for c in ("row", "vec_id", "label")}
    return x[:, order], y[:, order], plain(anchors), plain(rows)


def find_positives(rows: pa.Table, anchors: pa.Table, count: int) -> tuple[np.ndarray, ...]:
    """(anchor's row, row, id, score): the first ``count`` other rows of each anchor's label in this block."""
    x, y, a, r = _cell(rows, anchors)
    lengths = np.sqrt((x**2).sum(1))
    out = []
    for label in np.unique(a["label"]):
        near, far = np.flatnonzero(r["label"] == label), np.flatnonzero(a["label"] == label)
        largest = float(np.sqrt((y[near] ** 2).sum(1)).max(initial=0))
        for k in range(0, len(far), SLICE):
            open_ = far[k : k + SLICE]
            for level in (*LEVELS, -math.inf):
                i, j, score = pairs_at_least(x[open_], y[near], np.ceil(lengths[open_] * largest * level) if level > -math.inf else np.full(len(open_), -(2.0**62)))
                other = r["row"][near[j]] != a["row"][open_[i]]
                i, j, score = i[other], j[other], score[other]
                enough = np.bincount(i, minlength=len(open_)) >= min(count, len(near))
                enough |= level == -math.inf
                take = enough[i]
                best = firsts(i[take], score[take], r["vec_id"][near[j[take]]], count)
                at, to, s = open_[i[take][best]], near[j[take][best]], score[take][best]
                out.append((a["row"][at], r["row"][to], r["vec_id"][to], s))
                open_ = open_[~enough]
                if not len(open_):
                    break
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def find_negatives(rows: pa.Table, anchors: pa.Table, count: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(anchor's row, place of the positive, id, score): the first ``count`` rows of other labels in each window of this block.

    Thresholds start in the upper part of an anchor's windows and go down until
    each window has enough or its lower end is reached.
    """
    x, y, a, r = _cell(rows, anchors)
    held = [np.asarray(v.as_py(), np.int64) for v in anchors.column("scores")]
    most = max(map(len, held), default=0)
    bottom, top = np.full((len(x), most), 1, np.int64), np.zeros((len(x), most), np.int64)
    for n, scores in enumerate(held):
        bottom[n, : len(scores)], top[n, : len(scores)] = -(-low * scores // 100), high * scores // 100
    real = bottom <= top
    out = []
    able = np.flatnonzero(real.any(1))
    for k in range(0, len(able), SLICE):
        open_ = able[k : k + SLICE]
        floor_ = np.where(real, bottom, np.iinfo(np.int64).max)[open_].min(1)
        ceil_ = np.where(real, top, np.iinfo(np.int64).min)[open_].max(1)
        for share in (0.75, 0.5, 0.25, 0.0):
            least = floor_ + np.floor((ceil_ - floor_) * share)
            i, j, score = pairs_at_least(x[open_], y, least)
            other = r["label"][j] != a["label"][open_[i]]
            i, j, score = i[other], j[other], score[other]
            done = least <= floor_
            found = []
            full = np.ones(len(open_), bool)
            for p in range(most):
                inside = (score >= bottom[open_[i], p]) & (score <= top[open_[i], p])
                g = i[inside]
                full &= ~real[open_, p] | (np.bincount(g, minlength=len(open_)) >= count) | (least <= bottom[open_, p])
                best = np.flatnonzero(inside)[firsts(g, score[inside], r["vec_id"][j[inside]], count)]
                found.append((p, best))
            done |= full
            for p, best in found:
                best = best[done[i[best]]]
                out.append((a["row"][open_[i[best]]], np.full(len(best), p), r["vec_id"][j[best]], score[best]))
            open_, floor_, ceil_ = open_[~done], floor_[~done], ceil_[~done]
            if not len(open_):
                break
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _met(rows: DataFrame, anchors: DataFrame, run, schema: str, n_rows: int, n_anchors: int) -> DataFrame:
    """Every block of rows with every block of anchors, one pair of blocks in a task; blocks have bounded sizes."""
    row_blocks = max(-(-n_rows // ROWS_A_BLOCK), min(shuffle_partitions(rows.sparkSession), -(-n_rows // LEAST_ROWS)), 1)
    anchor_blocks = max(-(-n_anchors // ANCHORS_A_BLOCK), 1)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rows_of", dealt(row_blocks)).withColumn("anchors_of", each(anchor_blocks))
    right = anchors.withColumn("rows_of", each(row_blocks)).withColumn("anchors_of", dealt(anchor_blocks))
    names = [p.split()[0] for p in schema.split(", ")]

    # both sides come from one table: new names and back, so that each side's columns are its own
    right = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns]).toDF(*right.columns)

    def cell(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        found = run(l, r) if l.num_rows and r.num_rows else [[]] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=names)

    return left.groupBy("rows_of", "anchors_of").cogroup(right.groupBy("rows_of", "anchors_of")).applyInArrow(cell, schema)


def _best(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of each group with their ``rank``; each task keeps as many before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its integer inner product with the anchor, components
    taken as floor(scale * x). An anchor's positives are its first
    ``positives`` other rows of the same label; the negatives of a positive are
    the first ``negatives`` rows of other labels from ``low`` to ``high``
    hundredths of its score. Higher scores come first, ties by smaller id. A
    positive with a negative score has an empty window.

    Rows with a null id, label or vector, with null, NaN or infinite components,
    or with components beyond ``LARGEST`` when scaled take no part. Repeated
    rows are rows of their own, also as anchors and as each other's positives.
    Missing components of shorter vectors count as zero. ``is_anchor`` is a
    condition on ``vec_id``; by default ids divisible by 50 are anchors. Labels
    are whole numbers.

    Both searches are exact threshold joins of blocks of rows and blocks of
    anchors, see ``pairs_at_least``; each block passes on the few rows that can
    be among the first.
    """
    who = F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor
    q = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    fits = finite(F.col("v")) & F.forall("v", lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    kept = table.withColumns({"_own_label": F.col(label).cast("long") if isinstance(label, str) else label.cast("long")})
    kept = chosen(kept, {"vec_id": id_col, "v": vector_col, "label": "_own_label"}).withColumn("vec_id", F.col("vec_id").cast("long"))
    kept = kept.where("vec_id is not null and label is not null").where(fits)
    rows = materialize(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", q.alias("q"), who.alias("anchor")), "vectors")
    anchors = rows.where("anchor").drop("anchor")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    others = rows.drop("anchor")
    near = _met(others, anchors, lambda l, r: find_positives(l, r, positives), "anchor long, row long, id long, score long", n_rows, n_anchors)  # noqa: E741
    best = materialize(_best(near, ["anchor"], positives).select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).getField("positive_score").alias("scores"))
    windows = anchors.join(scores, anchors["row"] == scores["anchor"]).select("row", "vec_id", "label", "q", "scores")
    hard = _met(others, windows, lambda l, r: find_negatives(l, r, negatives, low, high), "anchor long, place long, id long, score long", n_rows, n_anchors)  # noqa: E741
    first = _best(hard, ["anchor", "place"], negatives).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return first.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
