"""Language identification by compression: the language whose sample text helps most to encode a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import chosen

#: Bytes of a language's dictionary, and of the piece that one sampled text gives to it.
DICTIONARY_BYTES, PIECE_BYTES = 64 << 10, 400
#: Distinct texts that a language's dictionary is made from, at most: those with the least hash.
SAMPLE_TEXTS = 512
#: A text is encoded in pieces of so many bytes, so that the dictionary counts in every part of a long text.
CHUNK_BYTES = 1024
#: Relative lead over the second language below which a prediction is not accepted.
MIN_MARGIN = 0.002
#: Bytes of lead that make the best language e times likelier than another.
SCALE_BYTES = 4.0
#: What stands for no language.
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def normal(text: str) -> bytes:
    """Lower-cased words of letters with one space between them; nothing if no character is a letter."""
    if not any(map(str.isalpha, text)):
        return b""
    return f" {' '.join(_WORD.findall(text.lower()))} ".encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    """Raw dictionary content by language, in the order of the names."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        how = zstandard.ZstdCompressionParameters.from_level(
            13, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        made = []
        for content in self.dictionaries.values():
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(compression_params=how, dict_data=words))
        return made


def encoded_sizes(data: bytes, encoders: list[zstandard.ZstdCompressor], chunk_bytes: int = CHUNK_BYTES) -> list[int]:
    """Bytes of the whole of ``data`` under each language's dictionary."""
    chunks = [data[i : i + chunk_bytes] for i in range(0, len(data), chunk_bytes)]
    return [sum(len(e.compress(c)) for c in chunks) for e in encoders]


def verdict(sizes: list[int]) -> tuple[int, float, float]:
    """(place of the smallest size, score, margin); of equal sizes the first. With one language both figures are 1."""
    found = np.asarray(sizes, float)
    best = int(found.argmin())
    score = 1 / np.exp(-(found - found[best]) / SCALE_BYTES).sum()
    second = np.delete(found, best).min(initial=np.inf)
    return best, float(score), float(1 - found[best] / second) if np.isfinite(second) else 1.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", may_learn: Column | None = None, sample_texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES) -> LanguageModel:
    """A dictionary for each language, from at most ``sample_texts`` distinct texts of it.

    ``may_learn`` is a condition on the column ``id``. Rows without a language,
    an id or a letter teach nothing; copies of a text count once. The rows
    sampled are cut down by a hash threshold before they meet, so that a
    language that holds most rows fills no task. The model grows with the number
    of languages alone. Without any labelled row it knows no language.
    """
    known = chosen(docs, {"id": id_col, "text": text_col, "lang": lang_col}).where("id is not null and lang is not null")
    known = known.where(F.col("text").rlike(r"\p{L}"))
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("text"), F.lit(1 << 52)).alias("h"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    if not counts:
        return LanguageModel()
    least = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 2 * sample_texts / max(n, 1)) * (1 << 52)))])
    few = known.where(F.col("h") < F.element_at(least, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("h")
    sample = few.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample_texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [normal(t) for t in batch.column("text").to_pylist()]
            at = [h % max(1, len(b) - PIECE_BYTES + 1) for h, b in zip(batch.column("h").to_pylist(), data, strict=True)]
            pieces = pa.array([b[i : i + PIECE_BYTES] for i, b in zip(at, data, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pieces], names=["lang", "place", "piece"])

    rows = sample.select("lang", "place", "h", "text").mapInArrow(cut, "lang string, place int, piece binary").collect()
    pieces: dict[str, list[tuple[int, bytes]]] = {}
    for lang, place, piece in rows:
        pieces.setdefault(lang, []).append((place, bytes(piece)))
    joined = {lang: b"".join(p for _, p in sorted(found))[:dictionary_bytes] for lang, found in sorted(pieces.items())}
    # the encoder takes no raw content of under 8 bytes
    return LanguageModel({lang: content.ljust(8) for lang, content in joined.items() if content})


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_margin: float = MIN_MARGIN) -> DataFrame:
    """The kept columns, ``lang_pred``, ``score``, ``margin`` and ``accepted`` of every whole text.

    The language with the smallest encoding is predicted; of equal ones the
    first name. ``accepted`` is false where its lead is narrower than
    ``min_margin``, a share of the second smallest. Texts that are null, empty
    or without a letter, and all texts under a model without languages, are
    ``und`` with score and margin 0, not accepted. A kept column that has the
    name of a result gives way to it.
    """
    kept = [c for c in keep if c not in ("lang_pred", "score", "margin", "accepted")]
    names = {f"c{i}": c for i, c in enumerate(kept)}
    rows = chosen(docs, names | {"text": text_col})
    languages = list(model.dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = model.encoders()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                data = normal(text.as_py() or "") if languages else b""
                if data:
                    best, score, margin = verdict(encoded_sizes(data, encoders))
                    out.append((languages[best], score, margin, margin >= min_margin))
                else:
                    out.append((UNKNOWN, 0.0, 0.0, False))
            lang, score, margin, accepted = zip(*out, strict=True) if out else ((), (), (), ())
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], names=[*names, "lang_pred", "score", "margin", "accepted"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names] + ["lang_pred string, score double, margin double, accepted boolean"])
    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in names.items()], "lang_pred", "score", "margin", "accepted")
