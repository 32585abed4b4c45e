"""Which fixed-length windows repeat across a corpus: two rounds of Spark shuffles over window bundles.

Texts lie in blocks of neighbouring ids, and every shuffled row stands for a
whole (block, bucket) pair: a packed array of the distinct keys of one block
that fall into one range of the key space. A key that a third of all texts
hold is thus at most one entry of each block. The answers go back as two bits
an entry; the block finds its entries again, because their order is fixed by
their content.

Round 1 ranks bundles by (anchor, digest). Equal bundles hold equal windows,
so whole bundles are settled at once, and anchors that occur once are dropped.
Round 2 goes on only for anchors whose bundles differ (where a repeated
passage begins or ends): there the windows themselves are ranked by the pair
of ranks of their parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_blocks
from tidemark.llm.kernels import Windows, packed_bits, unpacked_bits

#: What a block is told of an entry of round 1.
HERE, ALL, ASK, ALL_AND_ASK = range(4)
#: Which windows count as repeated: those of a smaller id, or those that start anywhere else.
EARLIER, ELSEWHERE = "earlier", "elsewhere"

_PACKED = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("round", pa.int32()), ("blob", pa.binary())])
_DDL = "block int, bucket int, round int, blob binary"


def _bytes_of(x: np.ndarray, low: int, high: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, low:high]


def _number(x: np.ndarray) -> np.ndarray:
    full = np.zeros((len(x), 8), np.uint8)
    full[:, : x.shape[1]] = x
    return full.view("<u8").reshape(-1)


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the key space, so that sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal rows begins."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _sorted(key: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Order by ``key``, equal keys by the other columns; most keys are unique, so only the rest is sorted twice."""
    order = np.argsort(key)
    head = _heads(key[order])
    size = np.diff(np.append(np.flatnonzero(head), len(head)))
    tied = np.repeat(size > 1, size)
    among = order[tied]
    order[tied] = among[np.lexsort((*[x[among] for x in then[::-1]], key[among]))]
    return order


class BlockBundles:
    """The bundles of one block of texts, their distinct entries in fixed order, and the answers applied to them."""

    def __init__(self, windows: Windows, ids: np.ndarray, rule: str, buckets: int):
        self.windows, self.rule, self.buckets = windows, rule, buckets
        self.text, self.start, self.count, anchor, digest = windows.bundles()
        self.ids = ids
        # 48 bits of the anchor beside its bucket and 63 of the digest; an anchor met by chance only costs a comparison
        self.key, bucket = anchor, _buckets(anchor, buckets)
        self.anchor = anchor & np.uint64((1 << 48) - 1)
        self.digest = digest & np.uint64((1 << 64) - 2)
        self.order = _sorted(anchor, self.digest)
        head = _heads(anchor[self.order], self.digest[self.order])
        self.entry = np.empty(len(self.order), np.int64)
        self.entry[self.order] = np.cumsum(head) - 1
        self.first = self.order[head]
        self.bucket = bucket[self.first]
        self.times = np.bincount(self.entry, minlength=len(self.first))
        self.states = np.zeros(len(self.first), np.uint8)

    def packed(self, block: int) -> pa.Table:
        """Round 1: 14 bytes an entry, by bucket; the digest's last bit says whether the block has it again."""
        f = self.first
        many = (self.times > 1).astype(np.uint64)
        body = np.concatenate([_bytes_of(self.anchor[f], 0, 6), _bytes_of(self.digest[f] | many, 0, 8)], axis=1)
        return _by_bucket(block, 1, self.bucket, body)

    def told(self, answers: dict[tuple[int, int], bytes]) -> None:
        bucket, n = np.unique(self.bucket, return_counts=True)
        at = np.concatenate([[0], np.cumsum(n)])
        for i, b in enumerate(bucket):
            if (blob := answers.get((1, int(b)))) is not None:
                self.states[at[i] : at[i + 1]] = unpacked_bits(blob, n[i])

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Round 2: distinct names of the windows in bundles to ask for, whether each surely repeats, and their buckets."""
        entries = np.flatnonzero(self.states >= ASK)
        names = self.windows.names(self._expanded(self.first[entries]))
        sure = np.repeat(self.states[entries] == ALL_AND_ASK, self.count[self.first[entries]])
        if self.rule == ELSEWHERE:
            names, inverse, times = np.unique(names, return_inverse=True, return_counts=True)
            many = (np.bincount(inverse, sure, len(names)) > 0) | (times > 1)
        else:
            names = np.unique(names)
            many = np.zeros(len(names), bool)
        return names, many, _buckets(names, self.buckets)

    def packed_names(self, block: int) -> pa.Table:
        names, many, bucket = self.asked()
        body = np.concatenate([_bytes_of(names, 0, 8), many.astype(np.uint8)[:, None]], axis=1)
        return _by_bucket(block, 2, bucket, body)

    def _expanded(self, bundles: np.ndarray) -> np.ndarray:
        n = self.count[bundles]
        return np.repeat(self.start[bundles], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)

    def repeated(self, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Starts of all repeated windows of the block, ascending."""
        self.told(answers)
        state = self.states[self.entry]
        found = [self._expanded(np.flatnonzero((state == ALL) | (state == ALL_AND_ASK)))]
        ask = np.flatnonzero(state == ASK)
        if len(ask):
            names, _, bucket = self.asked()
            hit = np.zeros(len(names), bool)
            value, n = np.unique(bucket, return_counts=True)
            at = np.concatenate([[0], np.cumsum(n)])
            for i, b in enumerate(value):
                if (blob := answers.get((2, int(b)))) is not None:
                    hit[at[i] : at[i + 1]] = unpacked_bits(blob, n[i]) > 0
            places = self._expanded(ask)
            found.append(places[hit[np.searchsorted(names, self.windows.names(places))]])
        found.append(self._within())
        return np.unique(np.concatenate(found))

    def _within(self) -> np.ndarray:
        """Windows repeated inside the block: whole bundles where an anchor has one kind, else window by window."""
        if not len(self.order):
            return self.order
        key, entry = self.key[self.order], self.entry[self.order]
        heads = np.flatnonzero(_heads(key))
        size = np.diff(np.append(heads, len(key)))
        kinds = np.add.reduceat(_heads(key, entry).astype(int), heads)
        plain = np.repeat((size > 1) & (kinds == 1), size)
        if self.rule == EARLIER:
            ids = self.ids[self.text[self.order]]
            plain &= ids > np.repeat(np.minimum.reduceat(ids, heads), size)
        whole = self._expanded(self.order[plain])
        bundles = self.order[np.repeat(kinds > 1, size)]
        places = self._expanded(bundles)
        if not len(places):
            return whole
        names = self.windows.names(places)
        order = np.argsort(names)
        head = _heads(names[order])
        group = np.cumsum(head) - 1
        if self.rule == ELSEWHERE:
            return np.concatenate([whole, places[order[(np.bincount(group) > 1)[group]]]])
        ids = np.repeat(self.ids[self.text[bundles]], self.count[bundles])[order]
        least = np.minimum.reduceat(ids, np.flatnonzero(head))
        return np.concatenate([whole, places[order[ids > least[group]]]])


def _by_bucket(block: int, step: int, bucket: np.ndarray, body: np.ndarray) -> pa.Table:
    value, at = np.unique(bucket, return_index=True)
    edges = np.append(at, len(bucket))
    blobs = [body[edges[i] : edges[i + 1]].tobytes() for i in range(len(value))]
    return pa.table([np.full(len(value), block, np.int32), value.astype(np.int32), np.full(len(value), step, np.int32), pa.array(blobs, pa.binary())], schema=_PACKED)


def _unpacked(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a bucket, the block of each, and the entry offsets of the rows."""
    blobs = rows["blob"].to_pylist()
    n = np.array([len(b) // width for b in blobs], np.int64)
    body = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
    return body, np.repeat(rows["block"].to_numpy().astype(np.int64), n), np.concatenate([[0], np.cumsum(n)])


def _answers(rows: pa.Table, step: int, states: np.ndarray, at: np.ndarray) -> pa.Table:
    """Two bits an entry back to each block; rows that say nothing are left out."""
    said = [i for i in range(rows.num_rows) if states[at[i] : at[i + 1]].any()]
    blobs = [packed_bits(states[at[i] : at[i + 1]]) for i in said]
    n = len(said)
    return pa.table([rows["block"].to_numpy()[said].astype(np.int32), rows["bucket"].to_numpy()[said].astype(np.int32), np.full(n, step, np.int32), pa.array(blobs, pa.binary())], schema=_PACKED)


def _rank_bundles(rule: str) -> Callable[[pa.Table], pa.Table]:
    def rank(rows: pa.Table) -> pa.Table:
        body, block, at = _unpacked(rows, 14)
        anchor, digest = _number(body[:, :6]), _number(body[:, 6:])
        many, digest = (digest & np.uint64(1)).astype(bool), digest >> np.uint64(1)
        order = _sorted(anchor, digest, block)
        a, d, b, m = anchor[order], digest[order], block[order], many[order]
        new_anchor = _heads(a)
        new_class = new_anchor | _heads(d)
        group, kind = np.cumsum(new_anchor) - 1, np.cumsum(new_class) - 1
        at_anchor, at_class = np.flatnonzero(new_anchor), np.flatnonzero(new_class)
        state = np.zeros(len(a), np.uint8)
        if len(a):
            apart = (np.minimum.reduceat(b, at_anchor) < np.maximum.reduceat(b, at_anchor))[group]
            mixed = (np.add.reduceat(new_class.astype(int), at_anchor) > 1)[group]
            home = np.minimum.reduceat(b, at_class)[kind]
            if rule == EARLIER:
                differ = (np.minimum.reduceat(home, at_anchor) < np.maximum.reduceat(home, at_anchor))[group]
                state[mixed & differ & (b == home)] = ASK
                state[apart & (b > home)] = ALL
            else:
                often = (np.add.reduceat(np.ones(len(a), int), at_class) + np.add.reduceat(m.astype(int), at_class) > 1)[kind]
                state[apart & often] = ALL
                state[apart & mixed & (b == home) & ~often] = ASK
                state[apart & mixed & (b == home) & often] = ALL_AND_ASK
        out = np.empty(len(state), np.uint8)
        out[order] = state
        return _answers(rows, 1, out, at)

    return rank


def _rank_names(rule: str) -> Callable[[pa.Table], pa.Table]:
    def rank(rows: pa.Table) -> pa.Table:
        body, block, at = _unpacked(rows, 9)
        names, many = _number(body[:, :8]), body[:, 8] > 0
        order = np.lexsort((block, names))
        head = _heads(names[order])
        group = np.cumsum(head) - 1
        if rule == EARLIER:
            state = ~head
        else:
            state = (np.bincount(group, minlength=1) + np.bincount(group, many[order], max(1, head.sum())) > 1)[group] if len(order) else head
        out = np.empty(len(state), np.uint8)
        out[order] = state
        return _answers(rows, 2, out, at)

    return rank


def _answered(rows: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(r, b): blob for r, b, blob in zip(rows["round"].to_pylist(), rows["bucket"].to_pylist(), rows["blob"].to_pylist(), strict=True)}


def mark_repeats(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    windows_of: Callable[[pa.Table], tuple[Windows, object]],
    rule: str,
    finish: Callable[[pa.Table, np.ndarray, object], pa.Table],
    schema: str,
    block_bytes: int | None = None,
) -> DataFrame:
    """Run both rounds; ``finish(rows, starts, extra)`` turns a block and its repeated window starts into output rows.

    ``docs`` holds exactly the columns that ``finish`` needs. Ids are whole
    numbers; null ids count as smaller than all others.
    """
    block, blocks = id_blocks(docs, id_col, text_col, *([block_bytes] if block_bytes else []))
    buckets = blocks
    placed = docs.withColumn("_block", block)

    def bundled(rows: pa.Table) -> tuple[BlockBundles, object, int]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between blocks
        ids = rows[id_col].fill_null(-(2**63)).to_numpy()
        windows, extra = windows_of(rows)
        return BlockBundles(windows, ids, rule, buckets), extra, rows["_block"][0].as_py()

    def first(rows: pa.Table) -> pa.Table:
        own, _, number = bundled(rows)
        return own.packed(number)

    def second(rows: pa.Table, said: pa.Table) -> pa.Table:
        if not rows.num_rows or not said.num_rows:
            return _PACKED.empty_table()
        own, _, number = bundled(rows)
        own.told(_answered(said))
        return own.packed_names(number)

    def last(rows: pa.Table, said: pa.Table) -> pa.Table:
        own, extra, _ = bundled(rows)
        return finish(rows, own.repeated(_answered(said)), extra)

    by_block = placed.groupBy("_block")
    one = by_block.applyInArrow(first, _DDL).groupBy("bucket").applyInArrow(_rank_bundles(rule), _DDL)
    two = by_block.cogroup(one.groupBy("block")).applyInArrow(second, _DDL).groupBy("bucket").applyInArrow(_rank_names(rule), _DDL)
    return by_block.cogroup(one.union(two).groupBy("block")).applyInArrow(last, schema)


def texts_in(rows: pa.Table, offsets: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, run starts, run stops) with places counted from the row's own start; runs never cross rows."""
    at = np.searchsorted(starts, offsets)
    for i in range(rows.num_rows):
        yield i, starts[at[i] : at[i + 1]] - offsets[i], stops[at[i] : at[i + 1]] - offsets[i]
