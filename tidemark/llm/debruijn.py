"""Substring dedup: compacted stretches of a de Bruijn graph of words, verified at their source coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bundles import ELSEWHERE, mark_repeats, texts_in
from tidemark.llm.common import chosen, text_or_empty
from tidemark.llm.kernels import WordWindows, buffer_of, runs_of, words
from tidemark.llm.suffix_dedup import runs_by_text

#: A repeated passage is at least so many words long.
MIN_WORDS = 35


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, carry: tuple[str, ...] = (), block_bytes: int | None = None) -> DataFrame:
    """(id, n_words, spans, kept, carried columns): each text without the words that lie in a repeated span.

    A word goes if a window of ``min_words`` words over it also starts anywhere
    else, in the same document or another. Every window is an edge of the de
    Bruijn graph from its first to its last ``min_words - 1`` words. Consecutive
    edges that share their anchor gram are compacted into one stretch before
    anything is shuffled; equal stretches meet in one Spark partition by that
    gram, as in graph builders that partition by minimizer, so repeated
    nonbranching paths are settled by one entry each. Where stretches with one
    gram differ, the graph branches, and there every edge is compared; the
    source coordinates of repeated edges then give the spans.

    ``kept`` is the remaining words joined by one space; ``spans`` counts
    words. Null texts have no words; shorter texts and empty tables lose
    nothing; repeated rows repeat each other; columns not named are left behind.
    """
    names = {"id": id_col, "text": text_col} | {f"carry_{i}": c for i, c in enumerate(carry)}
    rows = chosen(docs, names).withColumn("text", text_or_empty("text")).withColumn("id", F.col("id").cast("long"))
    types = dict(rows.dtypes)
    extra = "".join(f", carry_{i} {types[f'carry_{i}']}" for i in range(len(carry)))

    def windows_of(block: pa.Table) -> tuple[WordWindows, tuple[np.ndarray, ...]]:
        buf, offsets = buffer_of(block["text"])
        hashes, starts, stops, at = words(buf, offsets)
        return WordWindows(hashes, at, min_words), (buf, starts, stops, at)

    def finish(block: pa.Table, found: np.ndarray, of: tuple[np.ndarray, ...]) -> pa.Table:
        buf, starts, stops, at = of
        a, b = runs_by_text(at, found, min_words)
        keep = np.ones(len(starts), bool)
        keep[np.repeat(a, b - a) + runs_of(b - a)] = False
        size = (stops - starts + 1)[keep]
        edge = np.concatenate([[0], np.cumsum(size)])
        joined = buf[np.repeat(starts[keep] - edge[:-1], size) + np.arange(edge[-1])]
        joined[edge[1:] - 1] = 32
        kept_at = np.concatenate([[0], np.cumsum(keep)])[at]
        raw = joined.tobytes()
        kept = [raw[edge[x] : max(edge[x], edge[y] - 1)] for x, y in zip(kept_at[:-1], kept_at[1:], strict=True)]
        spans = [[{"start": int(x), "stop": int(y)} for x, y in zip(u, v, strict=True)] for _, u, v in texts_in(block, at, a, b)]
        return pa.table(
            [block["id"], pa.array(np.diff(at)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())]
            + [block[f"carry_{i}"] for i in range(len(carry))],
            names=["id", "n_words", "spans", "kept", *(f"carry_{i}" for i in range(len(carry)))],
        )

    schema = "id long, n_words long, spans array<struct<start: long, stop: long>>, kept binary" + extra
    done = mark_repeats(rows, "id", "text", windows_of, ELSEWHERE, finish, schema, block_bytes)
    return done.select(F.col("id").alias(id_col), "n_words", "spans", "kept", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])


def word_removal_report(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``remove_repeated_words``."""
    return done.select(
        id_col,
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
