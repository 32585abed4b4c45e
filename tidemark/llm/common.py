"""Shared helpers: tables, sizes, blocks of neighbouring ids, class labels over links."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Text bytes that one grouped task holds at a time.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(df: DataFrame, text: Column, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` that the texts of ``df`` fill; one aggregate over lengths."""
    total = df.select(F.octet_length(text).alias("n")).agg(F.sum("n")).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def id_blocks(df: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[Column, int]:
    """A block number that grows with the id, and the number of blocks.

    Blocks hold about equally many documents: their borders are approximate
    quantiles of the ids, one value for each block. Equal ids share a block.
    """
    n = block_count(df, F.col(text_col), block_bytes)
    if n == 1:
        return F.lit(0), 1
    cuts = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    edges = np.unique(np.asarray(cuts, np.int64))

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="left").astype(np.int32))

    return block_of(least_if_null(F.col(id_col).cast("long"))), len(edges) + 1


def least_if_null(ids: Column) -> Column:
    """Ids for a task: null as the least number, since pandas makes floats of ids beside a null."""
    return F.coalesce(ids, F.lit(-(2**63)))


def chosen(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the wanted columns of ``df`` under internal names; other columns, clashing or not, are left behind."""
    return df.select(*[df[f"`{source}`"].alias(target) for target, source in names.items()])


def hot_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", copies: int = 16) -> DataFrame:
    """Join where one key may hold a large share of ``left``: the rows of a key go to ``copies`` tasks, each with a copy of its row of ``right``."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(copies)).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return spread.join(copied, [on, "_salt"], how).drop("_salt")


def smallest_labels(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected ``edges`` (a, b).

    Each round links every node's larger neighbours, then its smaller ones, to
    its smallest neighbour; both keep what is connected, so chains shrink to
    stars in a logarithmic number of rounds. A hub's links are split over many
    tasks before its minimum meets them again. Nulls link nothing.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = hot_join(both, low, "a", "inner").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        small = hot_join(large, up, "b", "inner").select(
            F.explode(F.array(F.struct("m", F.col("b").alias("x")), F.struct("m", F.col("a").alias("x")))).alias("e")
        )
        now = materialize(small.select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).where("a <> b").distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("labels did not settle")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("label"))
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return materialize(stars.union(roots), "labels") if spark else stars


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_columns(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    return df.select(*[f"`{c}`" for c in kept])
