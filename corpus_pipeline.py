"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import byte_bpe, toxicity
from tidemark.llm.common import table
from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.session import materialize

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Words of a shingle and the least similarity in hundredths of the stage's near copies; op7 has its own.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below a half; it learns from the labels outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), may_learn=~toxicity.held_out(F.col("id")))
    score = _free(docs, "_toxicity")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies.

    An id is one document: its texts stay or go together, and equal texts of it are one row.
    """
    groups = jaccard_components(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    digest, place = _free(docs, "_digest"), _free(docs, "_place")
    again = Window.partitionBy("doc_id", digest).orderBy("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").withColumn(digest, F.sha2("text", 256))
    return kept.withColumn(place, F.row_number().over(again)).where(F.col(place) == 1).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that an earlier one has; a character cut in two goes, and the length follows."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = remove_repeats(docs, carry=others, as_text=True).withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item."""
    hits = find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether decoding gives the text back.

    The results are ``n_tokens``, ``ids`` and ``intact``; where a column of the documents
    has such a name it stays, and the result's gets an underscore.
    """
    plain = {f"in_{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in plain.items()])
    text = next(n for n, c in plain.items() if c == "text")
    done = byte_bpe.encode(rows, RANKS, public_tokenizers.PATTERN, text, tuple(plain), decoded=True)
    results = {
        "n_tokens": F.size("ids").cast("long"),
        "ids": F.col("ids"),
        "intact": F.coalesce(F.col(text), F.lit("")).cast("binary") == F.col("decoded"),
    }
    return done.select(*[F.col(n).alias(c) for n, c in plain.items()], *[v.alias(_free(docs, n)) for n, v in results.items()])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
