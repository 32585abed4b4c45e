"""Benchmark decontamination: SimHash windows of item size, a multi-index within a Hamming radius, exact similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chosen, text_or_empty
from tidemark.llm.kernels import ODD, SLICE, U, buffer_of, shingles, words

#: Words of a shingle and least weighted similarity.
WIDTH, SIMILARITY = 5, 0.8
#: Bits that may differ: five deviations above the mean for shingles of the least similarity.
RADIUS = 23
#: The fingerprint's parts; within the radius at least one part differs in at most RADIUS // PARTS bits.
PARTS = 8
#: Items that are looked for at a time; bounds all that is broadcast.
ITEM_BLOCK = 2000


def text_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle names in text order, and their offsets by text. Words are runs of letters and digits, lower-cased; letters beyond ASCII count."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    buf, offsets = buffer_of(lowered)
    names, _, _, at = words(buf, offsets, ODD)
    return shingles(names, at, width)


def simhash(names: np.ndarray) -> int:
    """64 bits: the majority of each bit over all shingles, repeated ones counted as often; ties are zero."""
    bits = np.unpackbits(names.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(names)).view("<u8")[0].astype(np.int64))


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all shingles, counted with repeats."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    shared = sum((x & y).values())
    return shared / (len(a) + len(b) - shared) if shared else 0.0


def variants(value: int, bits: int, radius: int) -> list[int]:
    """All values of ``bits`` bits that differ from ``value`` in at most ``radius``."""
    return [value ^ sum(1 << i for i in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def _items(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(id, shingle width, shingles) of the items that have words, a block at a time."""
    rows = chosen(items, {"id": id_col, "text": text_col}).select(F.col("id").cast("long").alias("id"), text_or_empty("text").alias("text"))
    block: list[tuple[int, int, np.ndarray]] = []
    for row in rows.orderBy("id", "text").toLocalIterator():
        text = pa.array([row["text"]], pa.string())
        found, _ = text_shingles(text, WIDTH)
        if len(found):
            buf, offsets = buffer_of(pc.utf8_lower(text))
            block.append((row["id"], min(WIDTH, len(words(buf, offsets, ODD)[0])), found))
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _windows(rows: DataFrame, block: list[tuple[int, int, np.ndarray]], similarity: float) -> DataFrame:
    """(id, width, size, start, mark, shingles): windows of an item's size that share enough shingles with some item to be similar.

    A window below this count of shared shingles can't reach the similarity, so
    none is lost; others are not worth a fingerprint.
    """
    by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for width in sorted({w for _, w, _ in block}):
        own = [(i, x) for i, (_, w, x) in enumerate(block) if w == width]
        flat = np.concatenate([np.unique(x) for _, x in own])
        item = np.concatenate([np.full(len(np.unique(x)), i) for i, x in own])
        order = np.lexsort((item, flat))
        by_width[width] = (flat[order], item[order], np.unique(flat))
    sizes = np.array([len(x) for _, _, x in block])
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(lengths) // (8 * SLICE))) + 1, [len(texts)]])
            out: list[tuple] = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                part = texts.slice(int(lo), int(hi - lo))
                for width, (flat, item, known) in by_width.items():
                    found, edges = text_shingles(part, width)
                    spot = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    hits = np.flatnonzero(known[spot] == found)
                    doc = np.searchsorted(edges, hits, side="right") - 1
                    for d in np.unique(doc):
                        base, count = int(edges[d]), int(edges[d + 1] - edges[d])
                        mine = hits[doc == d] - base
                        out += _of_document(ids[int(lo + d)].as_py(), width, found[base : base + count], mine, flat, item, sizes, share)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "width", "size", "start", "mark", "found"])

    return rows.mapInArrow(run, "id long, width int, size int, start int, mark long, found array<long>")


def _of_document(own: int | None, width: int, found: np.ndarray, hits: np.ndarray, flat: np.ndarray, item: np.ndarray, sizes: np.ndarray, share: float) -> Iterator[tuple]:
    lo, hi = np.searchsorted(flat, found[hits]), np.searchsorted(flat, found[hits], side="right")
    places = np.repeat(hits, hi - lo)
    items = item[np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))]
    order = np.argsort(items, kind="stable")
    places, items = places[order], items[order]
    heads = np.concatenate([[0], np.flatnonzero(np.diff(items)) + 1, [len(items)]])
    seen: set[tuple[int, int]] = set()
    for a, b in zip(heads[:-1], heads[1:], strict=True):
        size, at = int(sizes[items[a]]), places[a:b]
        span = min(size, len(found))
        need = share * (span + size) - 1e-9
        if b - a < need:
            continue
        starts = np.unique(np.concatenate([np.clip(at - k, 0, len(found) - span) for k in range(span)]))
        counts = np.searchsorted(at, starts + span) - np.searchsorted(at, starts)
        for s in starts[counts >= need]:
            if (size, int(s)) not in seen:
                seen.add((size, int(s)))
                names = found[s : s + span]
                yield own, width, size, int(s), simhash(names), names.astype(np.int64).tolist()


def _index(spark: SparkSession, block: list[tuple[int, int, np.ndarray]]) -> DataFrame:
    """Every item under all values of each part of its fingerprint within the part's radius."""
    bits = 64 // PARTS
    rows = []
    for number, (_, width, names) in enumerate(block):
        mark = simhash(names)
        for p in range(PARTS):
            value = (mark >> (p * bits)) & ((1 << bits) - 1)
            rows += [(width, len(names), p, v, number, mark) for v in variants(value, bits, RADIUS // PARTS)]
    return spark.createDataFrame(rows, "width int, size int, part int, value int, item int, item_mark long")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, similarity, first_word, n_windows): documents with a window similar to a benchmark item.

    Items are the stated query set; all documents are compared with one block of
    items after the other. A window has as many words as the item (all words of
    a shorter document). Windows and items meet when their 64-bit SimHashes
    agree in a part up to its share of the radius, so every pair within the
    radius meets; farther pairs go, and the weighted similarity of the exact
    shingles decides. The best window of each pair is returned, by the first of
    equals.

    Null or wordless texts and items match nothing; items below five words are
    one shingle; repeated rows of an id count as one document; empty tables
    give an empty result; other columns are left behind.
    """
    spark = docs.sparkSession
    rows = chosen(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("long"))
    bits = 64 // PARTS
    results: list[DataFrame] = []
    for block in _items(items, item_id_col, item_text_col):
        windows = _windows(rows, block, similarity)
        parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.shiftrightunsigned("mark", p * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("value")) for p in range(PARTS)]))
        cut = windows.select("*", parts.alias("x")).select("id", "width", "size", "start", "mark", "found", "x.part", "x.value")
        # the index has at most ITEM_BLOCK * PARTS * 37 narrow rows
        met = cut.join(F.broadcast(_index(spark, block)), ["width", "size", "part", "value"])
        apart = F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark")))
        # a pair that meets in several parts counts in the first of them
        agrees = [F.bit_count(F.shiftrightunsigned(F.col("mark").bitwiseXOR(F.col("item_mark")), p * bits).bitwiseAND(F.lit((1 << bits) - 1))) <= RADIUS // PARTS for p in range(PARTS)]
        first = F.coalesce(*[F.when(agrees[p], F.lit(p)) for p in range(PARTS)])
        close = met.where((apart <= RADIUS) & (F.col("part") == first)).select("id", "start", "item", "found")
        names = [x for _, _, x in block]
        numbers = [i for i, _, _ in block]

        def verify(batches: Iterator[pa.RecordBatch], names=names, numbers=numbers) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = batch.to_pydict()
                scores = [weighted_similarity(np.array(f, np.int64).view(U), names[i]) for f, i in zip(c["found"], c["item"], strict=True)]
                made = pa.RecordBatch.from_arrays([batch.column("id"), pa.array([numbers[i] for i in c["item"]], pa.int64()), pa.array(scores, pa.float64()), batch.column("start")], names=["id", "item_id", "score", "start"])
                yield made.filter(pc.greater_equal(made.column("score"), similarity - 1e-9))

        results.append(close.mapInArrow(verify, "id long, item_id long, score double, start int"))
    if not results:
        results = [spark.createDataFrame([], "id long, item_id long, score double, start int")]
    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    best = F.max(F.struct("score", (-F.col("start")).alias("s")))
    found = every.groupBy("id", "item_id").agg(best.alias("best"), F.countDistinct("start").alias("n_windows"))
    return found.select(F.col("id").alias(id_col), F.col("item_id").alias(item_id_col), F.col("best.score").alias("similarity"), (-F.col("best.s")).alias("first_word"), "n_windows")
