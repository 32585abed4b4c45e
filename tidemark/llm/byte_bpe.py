"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chosen, text_or_empty

#: Characters of text that are encoded at a time.
ENCODE_CHARS = 1 << 18
#: Tokens that are decoded at a time.
DECODE_TOKENS = 1 << 18
#: Words whose tokens are remembered; a small cache stays in the processor's own.
CACHED_WORDS = 2000


def byte_characters() -> list[str]:
    """A visible character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=4)
def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


@lru_cache(maxsize=4)
def build_tokenizer(raw: bytes, pattern: str):
    """A tokenizer with the merges that the ranks imply.

    A rank file lets any two neighbours merge whose concatenation is a token,
    the least rank first; so every split of a token into two tokens is a merge,
    ordered by the rank of the whole.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, chars = load_ranks(raw), byte_characters()
    spelled = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [
        (spelled[token[:i]], spelled[token[i:]])
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    made = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=CACHED_WORDS))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    made.decoder = decoders.ByteLevel()
    return made


@lru_cache(maxsize=4)
def byte_strings(raw: bytes) -> list[bytes]:
    """The bytes of each id, out of the byte table in reverse."""
    chars = byte_characters()
    back = {c: b for b, c in enumerate(chars)}
    spelled = {rank: "".join(chars[b] for b in token) for token, rank in load_ranks(raw).items()}
    return [bytes(back[c] for c in spelled.get(i, "")) for i in range(max(spelled) + 1)]


@lru_cache(maxsize=4)
def flat_table(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, and where each id's begin and how many they are."""
    strings = byte_strings(raw)
    sizes = np.array([len(x) for x in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes


def joined_bytes(ids: np.ndarray, counts: np.ndarray, raw: bytes) -> pa.BinaryArray:
    """The bytes of each row's ids; ``counts`` is the number of ids of each row."""
    flat, starts, sizes = flat_table(raw)
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    out = np.empty(ends[-1], np.uint8)
    for i in range(0, len(ids), DECODE_TOKENS):
        part = ids[i : i + DECODE_TOKENS]
        lo, hi = ends[i], ends[i + len(part)]
        out[lo:hi] = flat[np.repeat(starts[part] - ends[i : i + len(part)], sizes[part]) + np.arange(lo, hi)]
    rows = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(rows), pa.py_buffer(out)])


def decode_pieces(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of token after token; a character split over tokens comes with its last byte, stray bytes as U+FFFD."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield decoder.decode(piece)
    yield decoder.decode(b"", True)


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    group, size = [], 0
    for value in texts:
        text = value.as_py()
        group.append(text)
        size += len(text)
        if size >= ENCODE_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False, decoded: bool = False) -> DataFrame:
    """(kept columns, ids array<int>[, starts, stops array<int>][, decoded binary]): the token ids of each whole text.

    Every match of ``pattern`` is encoded separately, without special tokens.
    ``starts`` and ``stops`` are the code points that a token covers; tokens that
    share a split character share its place. ``decoded`` are the bytes of the ids,
    as ``decode`` gives them, made by the same worker. Kept columns of the names
    of these results give way to them. Null and empty texts have no ids;
    any row order, repeated rows and empty tables are fine; other columns are
    left behind. The rank file (under 1 MB) is read once and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())
    added = ["ids", "starts", "stops"] if offsets else ["ids"]
    made_here = [*added, "decoded"] if decoded else added
    names = {f"keep_{i}": c for i, c in enumerate(keep) if c not in made_here}
    rows = chosen(docs, names | {"text": text_col}).withColumn("text", text_or_empty("text"))
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = build_tokenizer(shared.value, pattern)
        call = made.encode_batch if offsets else made.encode_batch_fast
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            done = 0
            for group in _groups(batch.column("text")):
                found = [[np.array(x, np.int32)] for x in ([], [], [])[: len(added)]]
                sizes = []
                for e in call(group, add_special_tokens=False):
                    ids = np.array(e.ids, np.int32)
                    sizes.append(len(ids))
                    found[0].append(ids)
                    if offsets:
                        places = np.array(e.offsets, np.int32).reshape(-1, 2)
                        found[1].append(places[:, 0])
                        found[2].append(places[:, 1])
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, np.concatenate(x)) for x in found]
                if decoded:
                    lists.append(joined_bytes(lists[0].values.to_numpy(), np.array(sizes), shared.value))
                kept = [batch.column(n).slice(done, len(group)) for n in names]
                done += len(group)
                yield pa.RecordBatch.from_arrays(kept + lists, names=[*names, *made_here])

    schema = ", ".join([f"{n} {t}" for n, t in fields] + [f"{n} array<int>" for n in added] + ["decoded binary"] * decoded)
    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in names.items()], *made_here)


def decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` and ``decoded`` (binary): the bytes of the ids. Null ids give null; ``decode_pieces`` makes text of them. A column ``decoded`` gives way."""
    shared = encoded.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())
    names = {f"c{i}": c for i, c in enumerate(encoded.columns) if c != "decoded"}
    rows = chosen(encoded, names)
    ids = next(n for n, c in names.items() if c == ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            lists = batch.column(ids)
            out = joined_bytes(lists.flatten().to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), shared.value)
            out = pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.binary())) if lists.null_count else out
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*names, "decoded"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + ["decoded binary"])
    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in names.items()], "decoded")


def encoding_report(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of an encoded and decoded table."""
    return done.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
