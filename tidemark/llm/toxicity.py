"""Toxicity: a linear classifier whose scores may not move when identity terms are swapped."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chosen, text_or_empty
from tidemark.session import materialize

#: Hash buckets of words.
BUCKETS = 1 << 18
#: Labelled rows that the model is fitted on, at most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
#: Buckets with a weight: those whose share differs most between the labels.
WEIGHTS = 4096
#: Share of the squared score change under a swap in the loss.
SWAP_PENALTY = 5.0

#: Neutral names of groups; a term is swapped for the next of its row.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly", "teenage"),
)

_WORD = re.compile(r"[^\W\d_]+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (BUCKETS - 1)


def word_buckets(text: str) -> np.ndarray:
    """Distinct buckets of the lower-cased letter words of a whole text, ascending."""
    return np.unique(np.fromiter((zlib.crc32(w.encode()) for w in set(_WORD.findall(text.lower()))), np.int64) & (BUCKETS - 1))


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of some buckets, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        full = np.zeros(BUCKETS)
        full[self.buckets] = self.weights
        return full


def _featured(rows: DataFrame) -> DataFrame:
    """(id, label, buckets) of rows (id, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_buckets(t) for t in batch.column("text").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(at), values)], names=["id", "label", "buckets"])

    return rows.mapInArrow(run, "id long, label int, buckets array<int>")


def swapped(buckets: np.ndarray, swaps: dict[int, int]) -> np.ndarray:
    """The buckets after every identity term is replaced by the next of its group."""
    return np.unique(np.array([swaps.get(int(b), int(b)) for b in buckets], np.int64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_learn: Column | None = None, sample_rows: int = SAMPLE_ROWS, swap_penalty: float = SWAP_PENALTY, steps: int = 300) -> ToxicityModel:
    """Fit on a sample of at most ``sample_rows`` labelled rows; all of them if there are fewer.

    ``may_learn`` is a condition on the column ``id`` of the labels. Labels other
    than 0 and 1 and null ids are left out; of repeated ids the higher label
    holds. Without any label, or with one kind only, the model is its prior.
    """
    known = chosen(labels, {"id": id_col, "label": label_col}).where("id is not null and label in (0, 1)")
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy("id").agg(F.max("label").cast("int").alias("label"))
    sample = materialize(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "toxic-sample")
    texts = chosen(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("long"))
    # the sample has a fixed bound: at most sample_rows pairs of numbers
    rows = texts.join(F.broadcast(sample.withColumn("id", F.col("id").cast("long"))), "id").select("id", "label", text_or_empty("text").alias("text"))
    featured = materialize(_featured(rows), "toxic-features")
    total = featured.agg(F.count("*"), F.sum("label")).first()
    n, positive = total[0], total[1] or 0
    if not n or positive in (0, n):
        share = (positive + 0.5) / (n + 1)
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    share = F.lit(positive / n)
    counts = featured.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    score = F.abs(F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    best = [r[0] for r in counts.orderBy(score.desc(), "bucket").select("bucket").limit(WEIGHTS).collect()]
    swaps = {bucket(a): bucket(b) for group in IDENTITY_TERMS for a, b in zip(group, group[1:] + group[:1], strict=True)}
    wanted = np.unique(np.array([*best, *swaps, *swaps.values()], np.int64))
    spark = docs.sparkSession
    narrow = spark.createDataFrame([(int(b), i) for i, b in enumerate(wanted)], "bucket int, place int")
    kept = (
        featured.withColumn("row", F.xxhash64("id", "buckets"))
        .select("id", "row", "label", F.explode_outer("buckets").alias("bucket"))
        .join(F.broadcast(narrow), "bucket", "left")
        .groupBy("id", "row", "label")
        .agg(F.sort_array(F.collect_set("place")).alias("places"))
        .orderBy("id", "row")
        .collect()
    )
    rows_of = [np.array(r["places"], np.int64) for r in kept]
    y = np.array([r["label"] for r in kept], float)
    place = {int(b): i for i, b in enumerate(wanted)}
    weights, bias = train(rows_of, y, {place[a]: place[b] for a, b in swaps.items()}, len(wanted), swap_penalty, steps)
    return ToxicityModel(wanted, weights, bias)


def train(rows: list[np.ndarray], y: np.ndarray, swaps: dict[int, int], width: int, swap_penalty: float, steps: int, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
    """Logistic loss, plus the mean squared change of the linear score between a row and its swapped twin."""
    flat = np.concatenate([np.zeros(0, np.int64), *rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    twins = [(r, swapped(r, swaps)) for r in rows if any(int(b) in swaps for b in r)]
    plus = [np.setdiff1d(a, b) for a, b in twins]
    minus = [np.setdiff1d(b, a) for a, b in twins]
    t_flat = np.concatenate([np.zeros(0, np.int64), *plus, *minus])
    t_sign = np.concatenate([np.ones(sum(map(len, plus))), -np.ones(sum(map(len, minus)))])
    t_row = np.concatenate([np.repeat(np.arange(len(twins)), [len(x) for x in p]) for p in (plus, minus)]) if twins else np.zeros(0, np.int64)
    w, bias, n = np.zeros(width), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), len(rows)
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, w[flat], n))))
        grad = np.bincount(flat, (p - y)[row], width) / n + ridge * w
        if twins:
            change = np.bincount(t_row, t_sign * w[t_flat], len(twins))
            grad += 2 * swap_penalty * np.bincount(t_flat, t_sign * change[t_row], width) / len(twins)
        full = np.append(grad, (p - y).mean())
        mean = 0.9 * mean + 0.1 * full
        square = 0.99 * square + 0.01 * full**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * min(1.0, 4 * (1 - step / (steps + 1)))
        w -= move[:-1]
        bias -= float(move[-1])
    return w, bias


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and the score of each whole text, 0 to 1; null and empty texts get the intercept's."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    rows = chosen(docs, names)
    text = next(n for n, c in names.items() if c == text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            z = np.array([weights[word_buckets(t or "")].sum() for t in batch.column(text).to_pylist()]) + model.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*names, "score"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + ["score double"])
    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in names.items()], F.col("score").alias(score_col))


def held_out(id_col: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text divides by five; null ids are among them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))
