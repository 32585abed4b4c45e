"""Suffix dedup and substring dedup against brute force."""

import re
from collections import Counter

import pytest
from helpers import SCHEMA, awkward, documents, prose, sha

from tidemark.llm.debruijn import remove_repeated_words, word_removal_report
from tidemark.llm.suffix_dedup import removal_report, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_bytes(docs, size=50):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            first.setdefault(b[p : p + size], i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def by_words(docs, size=35):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    times = Counter(tuple(w[p : p + size]) for _, w in words for p in range(len(w) - size + 1))
    out = []
    for i, w in words:
        gone = bytearray(len(w))
        for p in range(len(w) - size + 1):
            if times[tuple(w[p : p + size])] > 1:
                gone[p : p + size] = b"\1" * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


TEXTS = [
    *awkward(),
    *("ab" * 200, "ba" * 150, "a" * 49, "a" * 50, "a" * 51, "zz" + "a" * 51),
    *(prose(9, 60), prose(8, 10) + prose(9, 60)[20:120] + prose(7, 10), prose(9, 60)[10:61], prose(9, 60)[10:59]),
    *(" ".join(["w"] * 34), " ".join(["u"] * 35), " ".join(["v"] * 36), " ".join(map(str, range(35))), " ".join(map(str, range(70)))),
]


@pytest.mark.parametrize("block_bytes", [1 << 22, 6000])
def test_removed_bytes(spark, block_bytes):
    got = removal_report(remove_repeats(documents(spark, TEXTS), block_bytes=block_bytes)).collect()
    assert sorted(map(tuple, got)) == by_bytes(list(enumerate(TEXTS)))


@pytest.mark.parametrize("block_bytes", [1 << 22, 6000])
def test_removed_words(spark, block_bytes):
    got = word_removal_report(remove_repeated_words(documents(spark, TEXTS), block_bytes=block_bytes)).collect()
    assert sorted(map(tuple, got)) == by_words(list(enumerate(TEXTS)))


def test_empty_tables(spark):
    assert remove_repeats(documents(spark, [])).count() == remove_repeated_words(documents(spark, [])).count() == 0


def test_repeated_and_null_ids(spark):
    text = prose(4, 40)
    docs = spark.createDataFrame([(3, text, "en", "s", 1), (3, text, "en", "s", 1), (9, text, "en", "s", 1)], SCHEMA)
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in removal_report(remove_repeats(docs)).collect()) == [(3, False), (3, False), (9, True)]
    assert all(r["n_removed"] == r["n_words"] for r in word_removal_report(remove_repeated_words(docs)).collect())
    null = docs.unionByName(spark.createDataFrame([(None, text, "en", "s", 1)], SCHEMA))
    assert sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in removal_report(remove_repeats(null)).collect()) == [("3", True), ("3", True), ("9", True), ("None", False)]


def test_clashing_columns_are_carried(spark):
    docs = documents(spark, [prose(1, 50)] * 2).selectExpr("doc_id", "text", "lang as block", "source as _block", "n_chars as spans", "lang as id", "lang as kept_")
    got = remove_repeats(docs, carry=("block", "_block", "id"), as_text=True).collect()
    assert [r["block"] for r in got] == ["en", "en"] and {r["_block"] for r in got} == {"src0", "src1"}
    assert sorted(len(r["kept"]) > 0 for r in got) == [False, True]


def test_cut_characters_go(spark):
    shared = "é" * 30
    got = remove_repeats(documents(spark, ["x" + shared, "中" + shared + "y"]), min_bytes=51, as_text=True).collect()
    assert all(set(r["kept"]) <= {"x", "y", "中", "é"} for r in got)
