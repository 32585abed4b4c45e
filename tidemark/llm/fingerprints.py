"""Document fingerprints: Order MinHash, which sees the order of what it samples."""

from __future__ import annotations

import hashlib
from functools import cmp_to_key, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chosen, id_blocks, least_if_null, text_or_empty
from tidemark.llm.kernels import M1, M2, U, pair, scramble

#: Characters of a k-mer, k-mers of a tuple, tuples of a fingerprint.
K, TUPLE, SLOTS = 6, 3, 64
_PLACE = U((1 << 21) - 1)


def _named_kmers(points: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(points))
    x = points[: len(points) - k + 1].astype(U)
    for i in range(1, k):
        x = x * M1 + points[i : len(points) - k + 1 + i]
    return scramble(x)


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each k-mer named together with its occurrence number, and its place."""
    n = len(names)
    if n <= int(_PLACE):
        # 43 bits of the name and the place in one number: one plain sort gives groups in text order
        both = np.sort((names & ~_PLACE) | np.arange(n, dtype=U))
        place, group = (both & _PLACE).astype(np.int64), both >> U(21)
    else:
        place = np.argsort(names, kind="stable")
        group = names[place] >> U(21)
    at = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = group[1:] != group[:-1]
    number = at - np.maximum.accumulate(np.where(head, at, 0))
    return scramble(group * M2 + number.astype(U)), place


@lru_cache(maxsize=4)
def _multipliers(slots: int) -> np.ndarray:
    """An odd number for each slot; times the scrambled names it gives the slot its own order of the k-mers."""
    return scramble(np.arange(1, slots + 1, dtype=U) * M1) | U(1)


def _bound(n: int, size: int) -> np.uint64:
    """Some five times as many numbered k-mers as a slot needs lie below."""
    return U(int(min(1.0, 5.0 * size / n) * (2.0**64 - 2048)))


def _below(hashes: np.ndarray, place: np.ndarray, bound: np.uint64, slots: int) -> list[np.ndarray]:
    """(slot, rank, hash, place) of the numbered k-mers that a slot ranks below the bound, slot after slot."""
    n, by = max(1, len(hashes)), _multipliers(slots)
    rows = max(1, (1 << 16) // n)
    found, values = [], []
    for i in range(0, slots, rows):
        ranks = (hashes * by[i : i + rows, None]).ravel()
        few = np.flatnonzero(ranks < bound)
        found.append(few + i * n)
        values.append(ranks[few])
    at = np.concatenate(found)
    slot = at // n
    at -= slot * n
    return [slot.astype(np.int16), np.concatenate(values), hashes[at], place[at]]


def _drawn(parts: list[list[np.ndarray]], hashes: np.ndarray, place: np.ndarray, size: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of each slot's least, from what lies below the bound; a slot that comes out short looks at all numbered k-mers."""
    slot, value, few, where = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(parts) > 1:
        order = np.argsort(slot, kind="stable")
        slot, value, few, where = slot[order], value[order], few[order], where[order]
    start = np.searchsorted(slot, np.arange(slots + 1))
    count = np.diff(start)
    wide = min(size, len(hashes))
    grid = np.full((slots, max(wide, int(count.max()))), ~U(0))
    grid[slot, np.arange(len(slot)) - start[slot]] = value
    first = np.minimum(start[:-1, None] + np.argsort(grid, axis=1, kind="stable")[:, :wide], max(0, len(slot) - 1))
    drawn, places = (few[first], where[first]) if len(slot) else (np.zeros((slots, wide), U), np.zeros((slots, wide), np.int64))
    for j in np.flatnonzero(count < wide):
        least = np.argsort(hashes * _multipliers(slots)[j], kind="stable")[:wide]
        drawn[j], places[j] = hashes[least], place[least]
    return drawn, places


def _least(hashes: np.ndarray, size: int, slots: int) -> np.ndarray:
    """Indices of the ``size`` least of all hashes in the order of each slot, one row a slot."""
    index = np.arange(len(hashes))
    return _drawn([_below(hashes, index, _bound(len(hashes), size), slots)], hashes, index, size, slots)[1]


def _marked(drawn: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The signature of what the slots have drawn, put back in text order."""
    drawn = np.take_along_axis(drawn, np.argsort(places, axis=1, kind="stable"), axis=1)
    made = np.zeros(len(drawn), U)
    for i in range(drawn.shape[1]):
        made = pair(made, drawn[:, i])
    return (made >> U(32)).astype(np.uint32)


def fingerprint(text: str, k: int = K, size: int = TUPLE, slots: int = SLOTS) -> np.ndarray:
    """``slots`` numbers of 32 bits. Each slot orders all numbered k-mers by a hash of its own, takes the ``size`` least ones, puts them back in text order and hashes that tuple.

    The empty text is all zeros; a text below ``k`` characters is one k-mer;
    below ``size`` k-mers a tuple is shorter.
    """
    if not text:
        return np.zeros(slots, np.uint32)
    hashes, place = _numbered_text(text, k)
    least = _least(hashes, size, slots)
    return _marked(hashes[least], place[least])


def _numbered_text(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    return _numbered(_named_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k))


def fingerprint_both(text: str, changed: str, shared: int, k: int = K, size: int = TUPLE, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of two texts that begin with the same ``shared`` code points.

    The k-mers of that beginning have the same occurrence numbers in both, so
    their least ones are drawn once and merged with those of either rest.
    """
    same = shared - k + 1
    if same <= 0 or min(len(text), len(changed)) < k:
        return fingerprint(text, k, size, slots), fingerprint(changed, k, size, slots)
    numbered = [_numbered_text(whole, k) for whole in (text, changed)]
    bound = _bound(min(len(hashes) for hashes, _ in numbered), size)
    hashes, place = numbered[0]
    begin = _below(hashes[place < same], place[place < same], bound, slots)
    ends = [_below(hashes[place >= same], place[place >= same], bound, slots) for hashes, place in numbered]
    first, second = (_marked(*_drawn([begin, end], *whole, size, slots)) for end, whole in zip(ends, numbered, strict=True))
    return first, second


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots."""
    return float((a == b).mean())


def spelled(mark: np.ndarray) -> str:
    return mark.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by as many first ones of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _before(a: tuple, b: tuple) -> int:
    """Descending ids, then ascending texts."""
    return (a[0] < b[0]) - (a[0] > b[0]) or (a[1] > b[1]) - (a[1] < b[1])


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = TUPLE, slots: int = SLOTS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each whole text.

    The next document has the next smaller id; after the smallest comes the
    largest. Documents lie in blocks of neighbouring ids; each block also gets
    the first document of the next one, so a text is shuffled once.

    Null texts are empty, null ids come last; rows with equal ids follow each
    other by text; a single document is its own next; an empty table gives an
    empty one; other columns are left behind.
    """
    rows = chosen(docs, {"id": id_col, "text": text_col}).withColumn("text", text_or_empty("text")).withColumn("id", F.col("id").cast("long"))
    block, _ = id_blocks(rows, "id", "text")
    # one id for each block, like the borders of the blocks themselves
    tops = sorted((r[0], r[1] if r[1] is not None else -(2**63)) for r in rows.select(block.alias("b"), "id").groupBy("b").agg(F.max("id").alias("id")).collect())
    heads = np.array([t[1] for t in tops], np.int64)
    goes = np.array([t[0] for t in tops[1:] + tops[:1]], np.int32)

    @F.pandas_udf("int")
    def also_in(ids: pd.Series) -> pd.Series:
        known = ids.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(heads, known), max(0, len(heads) - 1))
        return pd.Series(np.where(heads[at] == known, goes[at], -1).astype(np.int32)) if len(heads) else pd.Series(np.full(len(ids), -1, np.int32))

    own = F.struct(block.alias("b"), F.lit(False).alias("guard"))
    guest = F.struct(also_in(least_if_null(F.col("id"))).alias("b"), F.lit(True).alias("guard"))
    placed = rows.select("id", "text", F.explode(F.filter(F.array(own, guest), lambda x: x["b"] >= 0)).alias("x")).select(F.col("x.b").alias("b"), "id", "text", F.col("x.guard").alias("guard"))

    def run(part: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        ids = part["id"].fill_null(-(2**63)).to_pylist()
        rows_of = list(zip(ids, part["text"].to_pylist(), part["guard"].to_pylist(), strict=True))
        mine = sorted((r for r in rows_of if not r[2]), key=cmp_to_key(_before))
        after = sorted((r for r in rows_of if r[2]), key=cmp_to_key(_before))
        out: list[list] = []
        before = None
        for i, (own_id, text, _) in enumerate(mine):
            following = mine[i + 1][1] if i + 1 < len(mine) else after[0][1]
            changed = edited(text, following)
            mark, second = fingerprint_both(text, changed, len(text) - len(text) // 2, k, size, slots)
            if before is not None:
                out[-1][-1] = likeness(before, mark)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append([own_id if own_id != -(2**63) else None, len(text), digest, spelled(mark), spelled(second), likeness(mark, second), None])
            before = mark
        if mine:
            out[-1][-1] = likeness(before, fingerprint(after[0][1], k, size, slots))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    ddl = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    done = placed.groupBy("b").applyInArrow(run, ddl)
    return done.withColumnRenamed("id", id_col)
