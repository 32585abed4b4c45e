"""N-gram Jaccard join: keys of equal parts of sets give groups, in which sorted arrays are intersected exactly."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bundles import _bytes_of, _heads, _number
from tidemark.llm.common import chosen, hot_join, shuffle_partitions, smallest_labels, text_or_empty
from tidemark.llm.kernels import LOWER, M2, SLICE, U, buffer_of, pair, runs_of, scramble, shingles, words
from tidemark.session import materialize

#: Words of a shingle, and the least similarity in hundredths.
WIDTH, PERCENT = 4, 85
#: Ratio of the sizes at the two ends of a band. Changes no result, like all numbers below.
BAND = 1.4
#: Elements of the sets whose keys meet inside their task before they are sent on.
BLOCK = 1 << 19
#: Ranges of the key space at least, and elements of sets for which there is one more.
BUCKETS, BUCKET_ELEMENTS = 512, 3 << 20
#: Texts whose bytes are copied at a time.
TEXTS = 256
#: Sets of a block at most, so that two bytes tell them apart.
BLOCK_SETS = 1 << 16
#: Bits of a digest that name a set while groups are found; a clash only makes a group larger.
NODE = (1 << 40) - 1
#: Sets and elements that are compared in one go; a larger group is cut into tiles.
TILE, TILE_ELEMENTS = 1024, 1 << 20
#: Times the sets of a large group are dealt into tiles anew before all tiles of different classes meet.
TURNS = 2


def prefix_length(n: int, percent: int) -> int:
    """Two sets that reach the similarity share one of so many first elements."""
    return n - (percent * n + 99) // 100 + 1


def signature_bits(n: int) -> int:
    """Bitmap width of a set: the power of two from its size band, about four bits an element."""
    return 64 << max(0, math.ceil(math.log2(max(1, n) / 16)))


class Sets:
    """The distinct shingles of each text of an Arrow column, ascending, as 64-bit names."""

    def __init__(self, width: int):
        self.width = width

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for first in range(0, len(texts), TEXTS):  # copies of the bytes exist for so many texts at a time
            yield from self._of(texts.slice(first, TEXTS))

    def _of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        buf, offsets = buffer_of(texts)
        buf = LOWER[buf]
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 8 * SLICE, side="right")) - 1)
            part = np.concatenate([buf[offsets[i] : offsets[j]], np.zeros(64, np.uint8)])
            names, _, _, at = words(part, offsets[i : j + 1] - offsets[i])
            found, edges = shingles(names, at, self.width)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                x = np.sort(found[a:b])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x
            i = j


def digest_of(ordered: np.ndarray) -> int:
    """One signed number for a set: its size and the sum of its scrambled elements."""
    parts = np.append(scramble(ordered * M2), np.array([len(ordered)], U) * M2)
    return int(scramble(parts.sum(dtype=U, keepdims=True))[0].astype(np.int64))


def signature(ordered: np.ndarray) -> bytes:
    bits = np.zeros(signature_bits(len(ordered)), bool)
    bits[(scramble(ordered ^ M2) & U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def overlap_bounds(x: np.ndarray, n: int, ys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """No more shared elements than this with each row of ``ys``: each bit that only one side has stands for an element that the other lacks."""
    return np.minimum(n - np.bitwise_count(x & ~ys).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(ys & ~x).sum(axis=1, dtype=np.int64))


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    x, y = (_folded(np.frombuffer(s, np.uint8), min(len(a), len(b))) for s in (a, b))
    return int(overlap_bounds(x, n_a, y[None, :], np.array([n_b]))[0])


@lru_cache(maxsize=8)
def _bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, number of parts and spare parts of each band of sizes.

    Two linked sets differ in so many elements at most, and each of these
    changes one part: with one part more than that, some part is equal. Parts
    that are empty on both sides say nothing; so many may be, the spare ones.
    A band with no parts has sizes at which only equal sets link.
    """
    lows = [1]
    while lows[-1] < 1 << 31:
        lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * BAND)))
    parts, spare = [], []
    for low, high in zip(lows[:-1], lows[1:], strict=True):
        n = high - 1
        differ = (100 - percent) * (n + 100 * n // percent) // (100 + percent)
        more = 0
        for _ in range(4):
            empty = (differ + 1 + more) * math.exp(-low / (differ + 1 + more))
            more = min(differ, math.ceil(empty + 2 * math.sqrt(empty)))
        parts.append(differ + 1 + more if differ else 0)
        spare.append(more)
    return np.array(lows[:-1]), np.array(parts), np.array(spare)


def part_keys(flat: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets ``flat[at[i] : at[i + 1]]``, and the set of each. Two different sets that link share a key.

    A pair belongs to the band of its smaller set. For each band whose sets it
    may link with, a set is cut into that band's parts by ranges of the
    elements; a key names a part and all elements in it. A set with more empty
    parts than the spare ones has its first elements as keys besides.
    """
    size = np.diff(at)
    lows, parts, spare = _bands(percent)
    own = np.searchsorted(lows, size, side="right") - 1
    least = np.searchsorted(lows, -(-size * percent // 100), side="right") - 1
    mixed = scramble(flat * M2)
    keys, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    sparse = np.zeros(len(size), bool)
    for back in range(int((own - least).max(initial=0)) + 1):
        band = np.maximum(own - back, 0)
        use = (size > 0) & (own - back >= least) & (parts[band] > 0)
        if not use.any():
            continue
        inside = np.repeat(use, size)
        owner = np.repeat(np.flatnonzero(use), size[use])
        part = ((flat[inside] >> U(32)) * np.repeat(parts[band[use]].astype(U), size[use])) >> U(32)
        head = np.flatnonzero(_heads(owner, part))
        who = owner[head]
        keys.append(pair(np.add.reduceat(mixed[inside], head), part[head] | (band[who].astype(U) + U(1)) << U(40)))
        owners.append(who)
        sparse |= use & (parts[band] - np.bincount(who, minlength=len(size)) > spare[band])
    if sparse.any():
        count = prefix_length(size[sparse], percent)
        places = np.repeat(at[:-1][sparse], count) + runs_of(count)
        keys.append(pair(flat[places], np.zeros(len(places), U)))
        owners.append(np.repeat(np.flatnonzero(sparse), count))
    return np.concatenate(keys), np.concatenate(owners)


def _grouped(keys: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """For each owner the least one that is reachable over equal keys."""
    label = np.arange(count)
    order = np.argsort(keys, kind="stable")
    head = _heads(keys[order])
    size = np.diff(np.append(np.flatnonzero(head), len(head)))
    many = np.repeat(size > 1, size)
    who, size = owner[order[many]], size[size > 1]
    if not len(size):
        return label
    first = np.cumsum(size) - size
    while True:
        new = label.copy()
        np.minimum.at(new, who, np.repeat(np.minimum.reduceat(label[who], first), size))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _described(rows: DataFrame, width: int) -> DataFrame:
    """(id, h, n, digest): the size and name of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            found = [(len(x), digest_of(x) if len(x) else 0) for x in Sets(width).of(batch.column("text"))]
            n, digest = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n), pa.array(digest)], names=["id", "h", "n", "digest"])

    return rows.mapInArrow(run, "id long, h long, n long, digest long")


def _buckets(elements: int) -> int:
    return max(BUCKETS, math.ceil(elements / BUCKET_ELEMENTS))


def _meeting(texts: DataFrame, width: int, percent: int, elements: int, half: bool = False) -> DataFrame:
    """(digest): the sets that may link with one of another class, by how many of their elements other classes have.

    What a set has beyond one that it links with is less than its prefix, and
    so is what it has alone. Sets with more elements that no other class has
    cannot link; all others come out. Classes are a column ``class`` of
    ``texts``; where there is none, each row is its own. With ``half`` only the
    elements in the lower half of the hash space are sent: sets with too many
    lone ones among these are out as well, and the rest come out undecided.
    A shuffled row holds the elements of a block in one range, with the set of
    each; the sets whose elements are met go back to their block.
    """
    classed = "class" in texts.columns
    wide, bits = 14 if classed else 6, (_buckets(elements) - 1).bit_length()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        name, seen, block, held = TaskContext.get().partitionId() << 32, set(), [], 0
        for batch in batches:
            labels = batch.column("class").to_numpy() if classed else np.zeros(batch.num_rows, np.int64)
            for x, label in zip(Sets(width).of(batch.column("text")), labels, strict=True):
                if len(x) and (d := digest_of(x)) not in seen:
                    seen.add(d)
                    sent = x[: np.searchsorted(x, U(1 << 63))].copy() if half else x
                    block.append((d, len(sent) - prefix_length(len(x), percent) + 1, label, sent))
                    held += len(sent)
                if held >= BLOCK or len(block) == BLOCK_SETS:
                    yield packed(block, name)
                    name, block, held = name + 1, [], 0
        if block:
            yield packed(block, name)

    def packed(block: list[tuple[int, int, int, np.ndarray]], name: int) -> pa.RecordBatch:
        keys = np.concatenate([x for *_, x in block]) << U(half)
        owner = np.repeat(np.arange(len(block)), [len(x) for *_, x in block])
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        parts = [_bytes_of(keys << U(bits) >> U(32), 0, 4), _bytes_of(owner, 0, 2)]
        if classed:
            parts.append(_bytes_of(np.array([c for _, _, c, _ in block], np.int64)[owner], 0, 8))
        body = np.concatenate(parts, axis=1)
        bucket, start = np.unique(keys >> U(64 - bits), return_index=True)
        ends = np.append(start, len(keys))
        blobs = [body[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        sets = np.array([(d, least) for d, least, *_ in block], "<i8").tobytes()
        bucket = np.append(bucket.astype(np.int32), np.int32(block[0][0] % (1 << bits)))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), name)), pa.array([*blobs, b""], pa.binary()), pa.array([b""] * len(blobs) + [sets], pa.binary())], names=["bucket", "block", "entries", "sets"])

    def meet(rows: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        blobs = rows["entries"].to_pylist()
        body = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, wide)
        key = np.ascontiguousarray(body[:, :4]).view("<u4").reshape(-1)
        label = np.ascontiguousarray(body[:, 6:]).view("<i8").reshape(-1) if classed else np.arange(len(body))
        met = np.zeros(len(body), bool)
        if len(body):
            order = np.argsort(key)
            head = np.flatnonzero(_heads(key[order]))
            several = np.minimum.reduceat(label[order], head) != np.maximum.reduceat(label[order], head)
            met[order] = np.repeat(several, np.diff(np.append(head, len(body))))
        ends = np.cumsum([0] + [len(x) // wide for x in blobs])
        found = [body[a:b, 4:6][met[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([rows["block"], pa.array(found, pa.binary()), rows["sets"]], names=["block", "found", "sets"])

    def tally(rows: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        sets = np.frombuffer(b"".join(rows["sets"].to_pylist()), "<i8").reshape(-1, 2)
        found = np.frombuffer(b"".join(rows["found"].to_pylist()), "<u2")
        return pa.table([sets[np.bincount(found, minlength=len(sets)) >= sets[:, 1], 0]], names=["digest"])

    sent = texts.select("text", *["class"] * classed).mapInArrow(pack, "bucket int, block long, entries binary, sets binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block long, found binary, sets binary").where((F.octet_length("found") > 0) | (F.octet_length("sets") > 0))
    return met.groupBy("block").applyInArrow(tally, "digest long").distinct()


def _elements(texts: DataFrame) -> int:
    return texts.agg(F.sum("n")).first()[0] or 0


def _meeting_texts(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``texts`` of the sets that meet enough of the others that do, as far as rounds drop many."""
    before = _elements(texts)
    while True:
        texts = materialize(texts.join(_meeting(texts, width, percent, before), "digest", "left_semi"), "texts")
        left = _elements(texts)
        if 4 * left >= 3 * before:
            return texts
        before = left


def _candidates(rows: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """(a, b): links between names of sets, over which all sets that share a key can reach each other.

    Sets of one block that share a key are linked inside its task, and each
    distinct key of a block goes on once, with the least set that its set is
    linked with. A shuffled row holds all keys of a block in one range.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            block, seen, held = [], set(), 0
            for x in Sets(width).of(batch.column("text")):
                if len(x) and (d := digest_of(x)) not in seen:
                    seen.add(d)
                    block.append((d, x))
                    held += len(x)
                if held >= BLOCK:
                    yield packed(block)
                    block, held = [], 0
            if block:
                yield packed(block)

    def packed(block: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        node = np.array([d & NODE for d, _ in block], np.int64)
        at = np.concatenate([[0], np.cumsum([len(x) for _, x in block])])
        keys, owner = part_keys(np.concatenate([x for _, x in block]), at, percent)
        label = _grouped(keys, owner, len(block))
        keys, first = np.unique(keys, return_index=True)
        body = np.concatenate([_bytes_of(keys, 0, 5), _bytes_of(node[label[owner[first]]], 0, 5)], axis=1)
        bucket, start = np.unique((keys >> U(32)) * U(buckets) >> U(32), return_index=True)
        ends = np.append(start, len(keys))
        blobs = [body[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        moved = np.flatnonzero(node[label] != node)
        links = np.stack([node[moved], node[label[moved]]], axis=1).astype("<i8").tobytes()
        bucket = np.append(bucket.astype(np.int32), np.int32(int(node[0]) % buckets))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([*blobs, b""], pa.binary()), pa.array([b""] * len(blobs) + [links], pa.binary())], names=["bucket", "entries", "links"])

    def match(rows: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        body = np.frombuffer(b"".join(rows["entries"].to_pylist()), np.uint8).reshape(-1, 10)
        node, owner = np.unique(_number(body[:, 5:]).astype(np.int64), return_inverse=True)
        label = _grouped(_number(body[:, :5]), owner, len(node))
        moved = np.flatnonzero(label != np.arange(len(node)))
        inner = np.frombuffer(b"".join(rows["links"].to_pylist()), "<i8").reshape(-1, 2)
        return pa.table([np.concatenate([node[moved], inner[:, 0]]), np.concatenate([node[label[moved]], inner[:, 1]])], names=["a", "b"])

    return rows.select("text").mapInArrow(pack, "bucket int, entries binary, links binary").groupBy("bucket").applyInArrow(match, "a long, b long")


class Marks:
    """The bitmaps of sets of ascending size, those of one width in one array; each is compared at the narrower width of a pair."""

    def __init__(self, signatures: list[bytes]):
        self.width = np.array([len(x) for x in signatures])
        self.first, self.bits = {}, {}
        for w in np.unique(self.width):
            self.first[w] = int(np.searchsorted(self.width, w))
            own = [np.frombuffer(x, np.uint8) for x in signatures if len(x) == w]
            self.bits[w, w], self.bits[w, w // 2] = np.stack(own), np.stack([_folded(x, w // 2) for x in own])

    def fitting(self, i: int, j: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``j`` whose overlap with ``i`` may be enough."""
        w, kept = self.width[i], [j[:0]]
        x = self.bits[w, w][i - self.first[w]]
        for v in np.unique(self.width[j]):
            k = j[self.width[j] == v]
            if (v, w) in self.bits:
                bound = overlap_bounds(x, size[i], self.bits[v, w][k - self.first[v]], size[k])
                k = k[(100 + percent) * bound >= percent * (size[i] + size[k])]
            kept.append(k)
        return np.concatenate(kept)


def _joined(size: np.ndarray, marks: Marks | None, label: np.ndarray, side: np.ndarray, percent: int, shared: Callable[[int, np.ndarray], np.ndarray] | None) -> np.ndarray:
    """Classes over sets of ascending ``size`` that their bitmaps and, where given, the counts of shared elements link."""
    label = label.copy()
    last = np.searchsorted(size, size * 100 // percent, side="right")
    both = side.min() < side.max()
    for i in range(len(size) - 1):
        j = np.arange(i + 1, last[i])
        j = j[label[j] != label[i]]
        if both:
            j = j[side[j] != side[i]]
        if marks is not None and len(j):
            j = marks.fitting(i, j, size, percent)
        if shared is not None and len(j):
            j = j[(100 + percent) * shared(i, j) >= percent * (size[i] + size[j])]
        if len(j):
            classes = np.unique(label[np.append(j, i)])
            label[np.isin(label, classes)] = classes[0]
    return label


def linked(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """The classes of sets that the similarity links, named by their least label; sets of equal ``label`` are in one class already.

    Where there are two sides, only sets of different sides are compared.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[i] for i in order]
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(at[-1], bool)

    def shared(i: int, j: np.ndarray) -> np.ndarray:
        own = flat[at[i] : at[i + 1]]
        mark[own] = True
        hit = mark[flat[np.repeat(at[j], size[j]) + runs_of(size[j])]]
        mark[own] = False
        return np.add.reduceat(hit, np.cumsum(size[j]) - size[j], dtype=np.int64)

    marks = Marks([signature(x) for x in sets]) if len(sets) > 16 else None
    out = np.empty(len(order), np.int64)
    out[order] = _joined(size, marks, label[order], side[order], percent, shared)
    return out


def _groups(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``texts`` without the text, with the component of the sets that share keys with others."""
    groups = smallest_labels(_candidates(texts, width, percent, _buckets(_elements(texts))))
    return texts.drop("text").withColumn("node", F.col("digest").bitwiseAND(F.lit(NODE))).join(groups, "node").drop("node").withColumnRenamed("label", "component")


def _verified(texts: DataFrame, wanted: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that the exact sets give within each (component, tile) of ``wanted``, at most one a row.

    ``wanted`` has (digest, class, n, component, tile, side).
    """
    slots = max(4 * shuffle_partitions(texts.sparkSession), math.ceil(_elements(wanted) / TILE_ELEMENTS))
    placed = texts.select("digest", "text").join(wanted, "digest").select(F.pmod(F.xxhash64("component", "tile"), F.lit(slots)).alias("slot"), "component", "tile", "side", "digest", "class", "text")

    def run(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        component, tile, side, digest, label = (table[c].to_numpy() for c in ("component", "tile", "side", "digest", "class"))
        order = np.lexsort((digest, tile, component))
        edges = np.append(np.flatnonzero(_heads(component[order], tile[order])), len(order))
        new = label.copy()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            here = order[a:b]
            if (label[here] != label[here[0]]).any():
                new[here] = linked(list(Sets(width).of(table["text"].take(here).combine_chunks())), label[here], side[here], percent)
        moved = new != label
        return pa.table([label[moved], new[moved]], names=["a", "b"])

    return placed.groupBy("slot").applyInArrow(run, "a long, b long").distinct()


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` of components that the links have not made one class, with their classes."""
    classes = smallest_labels(links).select(F.col("node").alias("digest"), F.col("label").alias("class"))
    return _mixed(members.join(classes, "digest", "left").withColumn("class", F.coalesce("class", "digest")))


def _mixed(now: DataFrame) -> DataFrame:
    mixed = now.groupBy("component").agg(F.min("class").alias("l"), F.max("class").alias("h_")).where("l <> h_").select("component")
    return materialize(hot_join(now, mixed, "component", "inner"), "open")


def _tiles(count: Column, elements: Column) -> Column:
    return F.greatest(F.ceil(count / F.lit(TILE)), F.ceil(elements / F.lit(TILE_ELEMENTS))).cast("long")


def _tile_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``members`` for each pair of tiles of a component in which sets of different classes may link."""
    # classes stay together; sets that are alone go by size, so that few of their tiles are near each other
    shared = members.groupBy("class").count().where("count > 1").select("class", F.col("class").alias("home"))
    ordered = Window.partitionBy("component").orderBy("home", "n", "digest")
    before = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    tile = F.greatest(F.floor((F.row_number().over(ordered) - 1) / TILE), F.floor(F.coalesce(before, F.lit(0)) / TILE_ELEMENTS))
    tiled = materialize(hot_join(members, shared, "class").withColumn("tile", tile.cast("long")).drop("home"), "tiles")
    ends = tiled.groupBy("component", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("class").alias("c"), F.max("class").alias("d"))
    x, y = ends.alias("x"), ends.alias("y")
    apart = (F.col("x.c") != F.col("x.d")) | (F.col("y.c") != F.col("y.d")) | (F.col("x.c") != F.col("y.c"))
    near = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
    pairs = x.join(y, F.col("x.component") == F.col("y.component")).where((F.col("x.tile") <= F.col("y.tile")) & apart & near)
    pairs = pairs.select(F.col("x.component").alias("component"), F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))
    sides = pairs.select("component", F.xxhash64("i", "j").alias("pair"), F.explode(F.array(F.struct(F.col("i").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("j").alias("tile"), (F.col("i") < F.col("j")).cast("int").alias("side")))).alias("s"))
    sides = sides.select("component", "pair", "s.tile", "s.side").distinct()
    return tiled.join(sides, ["component", "tile"]).drop("tile").withColumnRenamed("pair", "tile")


def _refined(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """``members`` in smaller components: those that bitmaps make of their classes, tile by tile. Bitmaps move instead of texts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            sigs = pa.array([signature(x) for x in Sets(width).of(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "digest", "class", "n")), sigs], names=["component", "digest", "class", "n", "sig"])

    def run(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        component, tile, side, label, n = (table[c].to_numpy() for c in ("component", "tile", "side", "class", "n"))
        order = np.lexsort((n, tile, component))
        edges = np.append(np.flatnonzero(_heads(component[order], tile[order])), len(order))
        sigs = table["sig"].to_pylist()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            here = order[a:b]
            new = _joined(n[here], Marks([sigs[i] for i in here]), label[here], side[here], percent, None)
            moved = new != label[here]
            left.append(label[here][moved])
            right.append(new[moved])
        return pa.table([np.concatenate(left), np.concatenate(right)], names=["a", "b"])

    named = texts.select("digest", "text").join(members, "digest").select("component", "digest", "class", "n", "text")
    marked = named.mapInArrow(mark, "component long, digest long, class long, n long, sig binary")
    slots = 16 * shuffle_partitions(texts.sparkSession)
    met = _tile_pairs(materialize(marked, "bitmaps"), percent).withColumn("slot", F.pmod(F.xxhash64("component", "tile"), F.lit(slots)))
    links = met.groupBy("slot").applyInArrow(run, "a long, b long").distinct()
    found = smallest_labels(links).select(F.col("node").alias("class"), "label")
    return _mixed(hot_join(members.drop("component"), found, "class", "inner").withColumnRenamed("label", "component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): documents linked by the Jaccard similarity of their ``width``-word shingle sets.

    Words are split at ASCII white space, A-Z lower-cased. Equal sets are one
    node. Sets with too many elements that no other has are left out by
    ``_meeting``. Two linked sets share a key of ``part_keys``, so all links lie
    within groups over shared keys. One text of each set goes to its group's task,
    where sorted arrays are intersected exactly, pair by pair, but for pairs that
    are in one class already or whose bitmaps leave too little overlap; a row of
    links a set comes out. A large group is cut into tiles, dealt anew some
    times to find its classes; what is still in different classes is left out
    where other classes have too few of its elements and grouped anew; then the
    bitmaps meet tile by tile, and then the sets of what those leave.

    Null and empty texts and texts without words have no shingles and are
    their own component; a text of fewer words has one shingle; repeated rows
    share a component; null ids keep a row and never name a component with
    others; an empty table gives an empty one; other columns are left behind.
    """
    rows = chosen(docs, {"id": id_col, "text": text_col}).withColumn("text", text_or_empty("text")).withColumn("id", F.col("id").cast("long")).withColumn("h", F.xxhash64("text"))
    sets = materialize(_described(rows, width), "shingle-sets")
    once = sets.where("n > 0").groupBy("digest").agg(F.min("h").alias("h"), F.min("n").alias("n"))
    wanted = materialize(once.join(_meeting(rows, width, percent, _elements(sets) // 2, half=True), "digest"), "meeting")
    texts = materialize(rows.select("h", "text").dropDuplicates(["h"]).join(wanted, "h").select("digest", "n", "text"), "texts")
    texts = _meeting_texts(texts, width, percent)
    grouped = _groups(texts, width, percent)
    tiles = grouped.groupBy("component").agg(_tiles(F.count("*"), F.sum("n")).alias("tiles"))
    members = materialize(hot_join(grouped, tiles, "component", "inner"), "members")

    def dealt(rows_: DataFrame, turn: int) -> DataFrame:
        return rows_.withColumn("tile", F.pmod(F.xxhash64("digest", F.lit(turn)), F.col("tiles"))).withColumn("side", F.lit(0))

    links = materialize(_verified(texts, dealt(members.withColumn("class", F.col("digest")), 0), width, percent), "links")
    large = members.where("tiles > 1")
    if not large.isEmpty():
        for turn in range(1, TURNS + 1):
            links = links.union(materialize(_verified(texts, dealt(_open(large, links), turn), width, percent), "links"))
        open_ = _open(large, links).select("digest", "n", "class")
        apart = _meeting_texts(texts.select("digest", "text").join(open_, "digest"), width, percent)
        rest = _refined(texts, _mixed(_groups(apart, width, percent)), width, percent)
        links = links.union(_verified(texts, _tile_pairs(rest, percent), width, percent))
    classes = smallest_labels(links)
    ids = sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"))
    member = ids.join(classes.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    least = member.groupBy("label").agg(F.min("id").alias("component"))
    named = hot_join(member.select("digest", "label"), least, "label").select("digest", "component")
    out = hot_join(sets.select("id", "n", "digest"), named, "digest")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
