"""Suffix-array dedup: distributed prefix doubling over sampled positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bundles import EARLIER, mark_repeats, texts_in
from tidemark.llm.common import chosen, text_or_empty
from tidemark.llm.kernels import ByteWindows, buffer_of

#: A repeated passage is at least so many bytes long.
MIN_BYTES = 50


def runs_by_text(offsets: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs; runs of neighbouring texts that touch stay apart."""
    if not len(starts):
        return starts, starts
    text = np.searchsorted(offsets, starts, side="right")
    cut = np.flatnonzero((starts[1:] > starts[:-1] + length) | (text[1:] != text[:-1]))
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, carry: tuple[str, ...] = (), as_text: bool = False, block_bytes: int | None = None) -> DataFrame:
    """(id, n_bytes, spans, kept, carried columns): each text without the bytes that repeat an earlier document.

    A byte goes if a string of ``min_bytes`` bytes over it also starts in a
    document with a smaller id. Prefix doubling: positions are ranked by their
    first half window, positions whose rank is unique are dropped, and the rest
    are ranked again by the pair of ranks at offset zero and half a window,
    which reaches the threshold. Ranks are sorted in Spark partitions by range
    of rank; positions are the sampled ones of ``bundles``, and the last round
    looks at every position near them, so the result is the same as for all.

    Null texts are empty; texts shorter than ``min_bytes`` and an empty table
    lose nothing; equal ids are not smaller than one another, null ids are
    smaller than all others; columns that are not named are left behind.
    ``kept`` is binary; with ``as_text`` it is a string without the characters
    that a removed span cuts in two.
    """
    names = {"id": id_col, "text": text_col} | {f"carry_{i}": c for i, c in enumerate(carry)}
    rows = chosen(docs, names).withColumn("text", text_or_empty("text")).withColumn("id", F.col("id").cast("long"))
    types = dict(rows.dtypes)
    extra = "".join(f", carry_{i} {types[f'carry_{i}']}" for i in range(len(carry)))

    def windows_of(block: pa.Table) -> tuple[ByteWindows, tuple[np.ndarray, np.ndarray]]:
        buf, offsets = buffer_of(block["text"])
        return ByteWindows(buf, offsets, min_bytes), (buf, offsets)

    def finish(block: pa.Table, starts: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> pa.Table:
        buf, offsets = of
        spans, kept = [], []
        for i, a, b in texts_in(block, offsets, *runs_by_text(offsets, starts, min_bytes)):
            spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])
            text = buf[offsets[i] : offsets[i + 1]]
            keep = np.ones(len(text), bool)
            for x, y in zip(a, b, strict=True):
                keep[x:y] = False
            left = text[keep].tobytes()
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
        return pa.table(
            [block["id"], pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())]
            + [block[f"carry_{i}"] for i in range(len(carry))],
            names=["id", "n_bytes", "spans", "kept", *(f"carry_{i}" for i in range(len(carry)))],
        )

    schema = "id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept " + ("string" if as_text else "binary") + extra
    done = mark_repeats(rows, "id", "text", windows_of, EARLIER, finish, schema, block_bytes)
    return done.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])


def removal_report(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``remove_repeats``."""
    return done.select(
        id_col,
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
