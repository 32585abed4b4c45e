"""Large ids beside a null, and columns that clash with names of results."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from helpers import SCHEMA, documents, sha

from tidemark.llm import byte_bpe
from tidemark.llm.bundles import ALL, ASK, EARLIER, _rank_bundles
from tidemark.llm.fingerprints import compare_with_next, edited, fingerprint, fingerprint_both
from tidemark.llm.kernels import unpacked_bits

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_fingerprints_with_large_ids_and_a_null(spark):
    ids = [2**60 + 5, None, 2**60 + 3, 2**60 + 4, -(2**60)]
    texts = [f"text number {i} " * 40 for i in range(5)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    got = {r["doc_id"]: r for r in compare_with_next(docs).collect()}
    order = [0, 3, 2, 4, 1]
    assert set(got) == set(ids)
    for here, following in zip(order, order[1:] + order[:1], strict=True):
        assert got[ids[here]]["edited_sha256"] == sha(edited(texts[here], texts[following]))


def test_bundles_are_told_apart_by_all_but_one_bit_of_their_digest():
    """Digests of one anchor that agree in their lower 40 bits are two bundles, and nothing of them repeats."""
    rows = {"block": [0, 1], "bucket": [0, 0], "round": [1, 1]}
    for far in (1 << 40, 0):
        digests = np.array([2, 2 + far], "<u8")
        blobs = [b"anchor" + d.tobytes() for d in digests]
        said = _rank_bundles(EARLIER)(pa.table(rows | {"blob": pa.array(blobs, pa.binary())}))
        states = {b: unpacked_bits(x, 1)[0] for b, x in zip(said["block"].to_pylist(), said["blob"].to_pylist(), strict=True)}
        assert states == ({0: ASK, 1: ASK} if far else {1: ALL})


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["_text", "_toxicity", "_digest", "_place", "ids", "decoded", "n_tokens", "Intact", "keep_0"]
    plain = documents(spark, ["some plain words here", "others that differ in all words", "some plain words here"])
    docs = plain.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "a benchmark item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns[: len(docs.columns)] == docs.columns, name
        for r in made.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names], name
    assert made.columns[len(docs.columns) :] == ["n_tokens_", "ids_", "intact_"]
    assert all(r["intact_"] and r["n_tokens_"] == len(r["ids_"]) for r in made.collect())


def test_texts_of_one_id_stay_or_go_together(spark, tmp_path):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, a)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"][0]) for r in kept if r["doc_id"] is not None) == [(1, "a"), (7, "c")]


def test_shared_beginnings_change_no_fingerprint():
    texts = ["", "a", "abcde", "abcdefg", "abc" * 50, "x" * 3000, " ".join(map(str, range(900)))]
    for text in texts:
        for following in texts:
            changed = edited(text, following)
            one, two = fingerprint_both(text, changed, len(text) - len(text) // 2)
            assert (one == fingerprint(text)).all() and (two == fingerprint(changed)).all()


def test_decoding_in_the_same_worker_equals_decoding_apart(spark):
    texts = [None, "", "plain words", "中文 \U0001f600 é\x00", "a b " * 2000, "plain words"]
    docs = documents(spark, texts)
    both = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    apart = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))
    assert {r["doc_id"]: bytes(r["decoded"]) for r in both.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    clash = docs.selectExpr("*", "7 as ids", "8 as decoded")
    again = byte_bpe.encode(clash, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "ids", "decoded"), decoded=True)
    assert again.columns == ["doc_id", "ids", "decoded"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, both.collect()))
    nulls = spark.sql("select 1 as x, cast(null as array<int>) as ids union all select 2, array()")
    assert {r["x"]: r["decoded"] for r in byte_bpe.decode(nulls, RANKS).collect()} == {1: None, 2: b""}
