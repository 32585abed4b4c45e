"""Vector code compression: parts of integer vectors coded by their nearest codebook entry, found with fixed pivots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chosen, hot_join
from tidemark.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Pivots of each part position.
PIVOTS = 3
#: Scaled components are taken as whole numbers below this size, so that sums of squares stay exact.
LARGEST = 1 << 25


def finite(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components; false for null vectors."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def part_edges(width: int, parts: int = PARTS) -> list[int]:
    """Borders of consecutive parts; if the width cannot be dealt evenly, the first parts are longer by one."""
    each, more = divmod(width, parts)
    return [i * each + min(i, more) for i in range(parts + 1)]


@dataclass(frozen=True)
class Codebooks:
    """Entries by part (entries x part width), and the fixed pivots of each part."""

    entries: tuple[np.ndarray, ...]
    pivots: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        flat = [str(int(v)) for part in self.entries for v in part.ravel()]
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` (rows x width) to all rows of ``b``."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)


def spread_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """The first entry, then each time the entry farthest from the pivots so far; the first of equals."""
    taken = [0]
    while len(taken) < min(count, len(entries)):
        taken.append(int(squares(entries, entries[taken]).min(1).argmax()))
    return entries[taken]


def nearest(x: np.ndarray, entries: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance, evaluations) for every row of ``x``.

    By the triangle inequality an entry is at least as far as the largest
    difference between its and the row's distance to one pivot. Entries come in
    the order of these bounds; a row is done when the next bound is beyond its
    best exact distance. A bound that only equals it is evaluated, since a
    lower index wins ties.
    """
    from_pivots = np.sqrt(squares(entries, pivots).astype(float))
    bounds = np.zeros((len(x), len(entries)))
    for p in range(from_pivots.shape[1]):
        far = to_pivots[:, p, None].astype(float)
        # distances are stored as floats of 24 bits; the bound gives way by more than their error
        np.maximum(bounds, np.abs(far - from_pivots[None, :, p]) - 1e-6 * (far + from_pivots[None, :, p]) - 1e-6, out=bounds)
    bounds = np.maximum(bounds, 0) ** 2 * (1 - 1e-12)
    order = np.argsort(bounds, axis=1, kind="stable")
    best = np.full(len(x), np.iinfo(np.int64).max)
    at = np.full(len(x), len(entries))
    done = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for turn in range(len(entries)):
        entry = order[rows, turn]
        open_ = bounds[rows, entry] <= best[rows]
        rows, entry = rows[open_], entry[open_]
        if not len(rows):
            break
        exact = ((x[rows] - entries[entry]) ** 2).sum(1)
        wins = (exact < best[rows]) | ((exact == best[rows]) & (entry < at[rows]))
        best[rows[wins]], at[rows[wins]] = exact[wins], entry[wins]
        done[rows] += 1
    return at, best, done


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _with_pivots(rows: DataFrame, edges: list[int], pivots: tuple[np.ndarray, ...]) -> DataFrame:
    """Rows and the distance of each part to each pivot of its position, part after part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), edges[-1], np.int64)
            far = [np.sqrt(squares(q[:, a:b], pivots[k])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            flat = np.concatenate(far, axis=1).astype(np.float32)
            to = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), batch.column("q"), to], names=["vec_id", "label_key", "q", "far"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label_key {kinds['label_key']}, q array<int>, far array<float>")


def _assigned(batch: pa.RecordBatch, edges: list[int], books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its components, entry, squared distance, evaluations) for each part of the rows."""
    q = _matrix(batch.column("q"), edges[-1], np.int64)
    widths = [len(p) for p in books.pivots]
    far = _matrix(batch.column("far"), sum(widths), np.float32)
    starts = np.cumsum([0, *widths])
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        yield k, q[:, a:b], *nearest(q[:, a:b], books.entries[k], far[:, starts[k] : starts[k + 1]], books.pivots[k])


def _improved(rows: DataFrame, edges: list[int], books: Codebooks) -> Codebooks:
    """Every entry becomes the floor of the mean of its parts; each task sends one row for an entry's component at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(e) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches:
            for k, x, at, _, _ in _assigned(batch, edges, books):
                counts[k] += np.bincount(at, minlength=len(counts[k]))
                np.add.at(sums[k], at, x)
        out = [(k, e, i, int(v), int(counts[k][e])) for k, s in enumerate(sums) for e, i in np.ndindex(*s.shape) if counts[k][e] for v in [s[e, i]]]
        made = [pa.array([r[c] for r in out], pa.int32() if c < 3 else pa.int64()) for c in range(5)]
        yield pa.RecordBatch.from_arrays(made, names=["part", "entry", "place", "total", "n"])

    totals = rows.select("q", "far").mapInArrow(run, "part int, entry int, place int, total long, n long")
    entries = [e.copy() for e in books.entries]
    # as many rows as the codebooks have numbers
    for part, entry, place, total, n in totals.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).collect():
        entries[part][entry, place] = total // n
    return Codebooks(tuple(entries), books.pivots)


def _coded(rows: DataFrame, edges: list[int], books: Codebooks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_assigned(batch, edges, books))
            codes = np.stack([f[2] for f in found], 1).astype(np.uint8)
            made = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(f[3] for f in found), pa.int64()), pa.array(sum(f[4] for f in found), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), *made], names=["vec_id", "label_key", "code", "error", "evaluations"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label_key {kinds['label_key']}, code string, error long, evaluations long")


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, code, error, label_error, evaluations) of every kept vector, and the codebooks of at most 256 entries.

    Vectors that are null or hold null, NaN or infinite components are left
    out; all others are kept, repeated rows as rows of their own, null ids after
    all numbers. The codebooks start from the rows of the least ids; rows of one
    id come in the order of their vectors. With fewer rows than entries each
    codebook has as many entries as there are rows. A vector of another length
    than the first row's, or with a component beyond ``LARGEST`` when scaled,
    cannot be compared exactly: it has null codes and errors. ``evaluations`` counts the exact
    distances of the last assignment, at most parts x entries.

    Distances of parts to their pivots are computed once and stored beside the
    vectors; each round is a scan of that table without a shuffle of rows.
    """
    kept = chosen(table, {"vec_id": id_col, "v": vector_col, "label": label_col}).where(finite(F.col("v")))
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    key = F.struct(F.col("label").isNull().alias("none"), F.col("label"))
    fits = F.forall("v", lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    rows = kept.select("vec_id", F.to_json(key).alias("label_key"), F.when(fits, scaled).cast("array<int>").alias("q"))
    first = rows.where("q is not null").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    width = len(first[0]["q"]) if first else 0
    first = [r["q"] for r in first if len(r["q"]) == width]
    edges = part_edges(width, parts)
    start = np.array(first, np.int64).reshape(len(first), width)
    cut = tuple(start[:, a:b] for a, b in zip(edges, edges[1:], strict=False))
    books = Codebooks(cut, tuple(spread_pivots(c, pivots) if len(c) else c for c in cut))
    same = F.coalesce(F.size("q") == width, F.lit(False))
    ready = materialize(_with_pivots(rows.where(same), edges, books.pivots), "vector-parts") if first else None
    for _ in range(rounds if first else 0):
        books = _improved(ready, edges, books)
    odd = rows.where(~same).select("vec_id", "label_key", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("evaluations", "long"))])
    coded = materialize(_coded(ready, edges, books).unionByName(odd), "vector-codes") if first else odd
    by_label = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    return hot_join(coded, by_label, "label_key").select("vec_id", "code", "error", "label_error", "evaluations"), books
