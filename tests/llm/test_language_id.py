"""Language by compression: held-out accuracy, the sizes it decides by, awkward tables."""

import zlib

import duckdb
import numpy as np
import pytest
from helpers import SCHEMA, awkward, documents
from pyspark.sql import functions as F

from tidemark.llm import language_id as lid
from tidemark.llm.queries import op11_language_id

SF = "/root/testdata/sf0.01"
EN = "the cat sat on the mat and the dog ran with the ball over there when it was late"
DE = "die katze lag auf der matte und der hund lief mit dem ball dorthin als es spät war"


def learned(spark, extra=()):
    rows = [(i, f"{EN} {i % 7} and then they were there" if i % 2 else f"{DE} und dann waren sie {i % 5} dort", "en" if i % 2 else "de", None, 0) for i in range(60)]
    return lid.fit(spark.createDataFrame([*rows, *extra], SCHEMA), may_learn=F.lit(True))


def test_held_out_accuracy_and_contract(spark):
    got = {r["doc_id"]: r for r in op11_language_id(spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    assert set(got) == {d[0] for d in docs}
    for i, _, _ in docs:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i]["lang_pred"], lang) for i, text, lang in docs if got[i]["held_out"] and lang]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in got.values()} <= {"en", "de", "fr", "es", "und"}


def test_smallest_encoding_wins_and_narrow_margins_are_rejected(spark):
    model = learned(spark)
    assert list(model.dictionaries) == ["de", "en"]
    texts = [EN, DE, EN.upper() + "!!", "x", (EN + "\n") * 3000]
    rows = lid.predict(documents(spark, texts), model, min_margin=0.01).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["en", "de", "en"] and rows[4]["lang_pred"] == "en"
    for r, t in zip(rows, texts, strict=True):
        sizes = lid.encoded_sizes(lid.normal(t), model.encoders())
        assert r["lang_pred"] == list(model.dictionaries)[int(np.argmin(sizes))]
        assert r["margin"] == pytest.approx(1 - min(sizes) / max(sizes))
        assert r["accepted"] == (r["margin"] >= 0.01)
    assert not rows[3]["accepted"] and rows[0]["accepted"]


def test_labels_of_the_held_out_part_teach_nothing(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", None, 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") >= 20, "fr").otherwise(F.col("lang")))
    may = F.col("id") < 20
    assert lid.fit(docs, may_learn=may) == lid.fit(wrong, may_learn=may)


def test_awkward_texts(spark):
    model = learned(spark, [(90, None, "fr", None, 0), (91, "1 2 3", "es", None, 0), (None, EN, "it", None, 0), (92, EN, None, None, 0), (93, "", "", None, 0)])
    assert list(model.dictionaries) == ["de", "en"]
    docs = documents(spark, [*awkward(), "123 ... ²", "é"]).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    rows = {r["doc_id"]: r for r in lid.predict(docs, model, keep=("doc_id", "score", "source")).collect()}
    texts = [*awkward(), "123 ... ²", "é"]
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {"doc_id", "source", "lang_pred", "score", "margin", "accepted"}
    for i, t in enumerate(texts):
        assert (rows[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))
        assert rows[i]["lang_pred"] != "und" or (rows[i]["score"], rows[i]["accepted"]) == (0.0, False)
    assert rows[3][1:] == rows[4][1:] or rows[3]["lang_pred"] == rows[4]["lang_pred"]


def test_empty_tables_and_single_languages(spark):
    none = documents(spark, [])
    empty = lid.fit(none)
    assert empty.dictionaries == {} and lid.predict(none, empty).count() == 0
    assert [r["lang_pred"] for r in lid.predict(documents(spark, ["word"]), empty).collect()] == ["und"]
    one = lid.fit(documents(spark, [EN]))
    row = lid.predict(documents(spark, ["word"]), one).first()
    assert (row["lang_pred"], row["score"], row["margin"], row["accepted"]) == ("en", 1.0, 1.0, True)
    tiny = lid.fit(documents(spark, ["a"]))
    assert lid.predict(documents(spark, ["b"]), tiny).first()["lang_pred"] == "en"


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = [(i, EN, "en", None, 0) for i in range(500)] + [(1000 + i, f"{DE} nummer {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", "de", None, 0) for i in range(100)]
    model = lid.fit(spark.createDataFrame(rows, SCHEMA), may_learn=F.lit(True), sample_texts=8)
    assert len(model.dictionaries["en"]) == len(lid.normal(EN))
    assert 0 < len(model.dictionaries["de"]) <= 8 * lid.PIECE_BYTES
