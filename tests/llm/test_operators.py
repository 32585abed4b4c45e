"""The other operators: brute force, exact round trips, held-out accuracy, awkward tables."""

import base64
import gzip
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from helpers import SCHEMA, awkward, documents, prose, sha
from pyspark.sql import functions as F

from tidemark.llm import archives, byte_bpe, toxicity, url_filter
from tidemark.llm.common import smallest_labels
from tidemark.llm.decontaminate import find_contamination, simhash, variants
from tidemark.llm.fingerprints import compare_with_next, edited, fingerprint, likeness
from tidemark.llm.licenses import TEMPLATES, scan_licences
from tidemark.llm.ngram_join import Sets, jaccard_components, overlap_bound, part_keys, signature

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- licences


def test_licences_of_headers_and_directories(spark):
    notice = {k: t for k, t in TEMPLATES[::-1]}
    files = [
        (1, "a/LICENSE", "some words\n" + notice["MIT"]),
        (2, "a/b/c/x.py", "code"),
        (3, "a/b/LICENSE.txt", notice["Apache-2.0"]),
        (4, "a/b/c/y.py", "# " + notice["GPL-3.0"] + "\ncode"),
        (5, "z/w.py", "no license here, only a few other words"),
        (6, None, notice["MIT"]),
        (7, "a/LICENSE", None),
        (8, "top.txt", ""),
        (9, "LICENSE-old", " ".join(["word"] * 2000)),
    ]
    df = spark.createDataFrame(files, "id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("directory", F.lit(1))
    got = {r["id"]: (r["license"], r["license_from"], r["inherited_from"]) for r in scan_licences(df, "id", F.col("path")).collect()}
    assert got[1] == ("MIT", "file", None)
    assert got[2] == ("Apache-2.0", "inherited", "a/b")
    assert got[3][:2] == ("Apache-2.0", "file")
    assert got[4][:2] == ("GPL-3.0", "header")
    assert got[5][:2] == (None, "none")
    assert got[6][:2] == ("MIT", "header")
    assert got[7] == ("MIT", "inherited", "a")
    assert got[8][:2] == got[9][:2] == (None, "none")
    assert scan_licences(df.limit(0), "id", F.col("path")).count() == 0


def test_licence_score_is_the_cosine(spark):
    texts = ["Licensed under the Apache License, Version 2.0 for all of this", "no words", "the license of the day"]
    df = documents(spark, texts)
    got = scan_licences(df, "doc_id", F.lit("d/f"), threshold=0.0).orderBy("doc_id").collect()
    term = re.compile(r"[a-z]+(?:-[a-z0-9]+)*|[0-9]+(?:\.[0-9]+)*")
    vocabulary = {t for _, x in TEMPLATES for t in term.findall(x.lower())}
    n = Counter(t for x in texts for t in set(term.findall(x.lower())) & vocabulary)
    idf = lambda t: math.log(4 / (n[t] + 1)) + 1
    vector = lambda x: {t: c * idf(t) for t, c in Counter(term.findall(x.lower())).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    best = max(sum(w * b.get(t, 0) for t, w in a.items()) / norm(a) / norm(b) for a in [vector(texts[0])] for b in [vector(x) for _, x in TEMPLATES])
    assert got[0]["own_score"] == pytest.approx(best)
    assert got[1]["own_license"] is None


def test_licences_of_wrapped_texts(spark):
    import textwrap

    from tidemark.llm.licenses import TEXTS

    whole = {}
    for k, t in TEXTS:
        whole[k] = max(whole.get(k, ""), t, key=len)
    wrap = lambda k, mark="": "\n".join(mark + x for x in textwrap.wrap(whole[k], 60))
    bsd = " * Redistribution and use in source and binary forms, with or\n * without modification, are permitted provided that the\n * following conditions are met:\n"
    filler = "\n".join(f"value{i} = compute{i}" for i in range(40))
    files = [("BSD-3-Clause", "a/x.c", "/*\n" + bsd + " */\n" + filler), ("MIT", "b/LICENSE", "Copyright (c) 2020 A. Person\n\n" + wrap("MIT")), ("MIT", "c/x.py", "Released under MIT.\n" + filler)]
    files += [(k, f"d{i}/x.py", "first = 1\n" + wrap(k, "# ") + "\n" + filler) for i, k in enumerate(("GPL-3.0", "ISC", "Apache-2.0", "MPL-2.0", "BSD-2-Clause"))]
    files += [("GPL-3.0", "e/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + filler), (None, "f/x.py", filler)]
    df = spark.createDataFrame([(i, p, t) for i, (_, p, t) in enumerate(files)], "id long, path string, text string")
    got = {r["id"]: r["own_license"] for r in scan_licences(df, "id", F.col("path")).collect()}
    assert got == {i: k for i, (k, _, _) in enumerate(files)}


# ---- URLs


def test_rules_hosts_and_paths(spark):
    urls = ["http://A.Org/x", "https://sub.example.org/es/1", "https://example.org/en/12#a", "https://notexample.org/es/1", "http://x.com/de/?q", "nothing", None, "http://org", "x://h.com/fr/a?b://c", "http://porg/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    model = url_filter.fit(url_filter.labelled_urls(spark))
    got = {r["page_id"]: r for r in url_filter.judge(df, model).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/de/", None, None, None, "com/fr/", None]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4, 8)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert (got[0]["host"], got[0]["path"]) == ("a.org", "/x") and (got[5]["host"], got[6]["path"]) == ("", "")
    assert (got[7]["host"], got[7]["path"], got[2]["path"], got[4]["path"]) == ("org", "", "/en/12", "/de/")
    assert url_filter.judge(df.limit(0), model).count() == 0


def test_url_model_on_new_words(spark):
    model = url_filter.fit(url_filter.labelled_urls(spark))
    bad = ["http://casino-win.example.net/x", "https://cheap-pills.shop/", "http://spam-farm.io/a", "https://adult-xxx.com/"]
    good = ["https://cityhistory.org/books", "http://teacherforum.net/", "https://university-museum.edu/", "https://mountainweather.com/"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    p = {r["page_id"]: r["p_blocked"] for r in url_filter.judge(df, model, rules=()).collect()}
    assert min(p[i] for i in range(4)) > max(p[i] for i in range(4, 8))
    host, path = "a.b", "/c"
    row = spark.range(1).select(url_filter.buckets_of(F.lit(host), F.lit(path)).alias("b"), model.probability(F.lit(host), F.lit(path)).alias("p")).first()
    assert row["p"] == pytest.approx(1 / (1 + math.exp(-model.intercept - sum(model.weights[b - 1] for b in row["b"]))))


# ---- fingerprints


def test_fingerprints_with_the_next_document(spark):
    texts = awkward()
    got = {r["doc_id"]: r for r in compare_with_next(documents(spark, texts).withColumn("b", F.lit(1)).withColumn("guard", F.lit(1))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        changed = edited(t, nxt)
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == sha(changed)
        assert got[i]["near_edited"] == likeness(fingerprint(t), fingerprint(changed))
        assert got[i]["near_next"] == likeness(fingerprint(t), fingerprint(nxt))
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[6]["near_next"] == 1.0


def test_fingerprint_blocks_agree(spark, monkeypatch):
    import tidemark.llm.fingerprints as module

    docs = documents(spark, [prose(i, 60) for i in range(40)] + [None, ""])
    one = sorted(map(tuple, compare_with_next(docs).collect()))
    real = module.id_blocks
    monkeypatch.setattr(module, "id_blocks", lambda *a: real(*a, 1500))
    assert sorted(map(tuple, compare_with_next(docs).collect())) == one


def test_fingerprint_sees_order_and_edits():
    a, b = prose(1, 400), prose(2, 400)
    small = a[:1000] + "zzz" + a[1003:]
    shuffled = " ".join(sorted(a.split(" ")))
    assert likeness(fingerprint(a), fingerprint(small)) > 0.85
    assert likeness(fingerprint(a), fingerprint(b)) < 0.1
    assert likeness(fingerprint(a), fingerprint(shuffled)) < 0.5 < likeness(fingerprint(a), fingerprint(small))
    # occurrence numbers: a repeated text differs from one copy of it
    assert likeness(fingerprint("abcdefghij"), fingerprint("abcdefghij" * 40)) < 1
    assert likeness(fingerprint("ab"), fingerprint("ab")) == 1.0 and fingerprint("").max() == 0


def test_fingerprint_of_short_swapped_texts():
    import random

    rng = random.Random(5)
    for n, most in ((40, 0.15), (60, 0.2), (100, 0.25), (200, 0.3)):
        texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for _ in range(100)]
        assert np.mean([likeness(fingerprint(t), fingerprint(t[n // 2 :] + t[: n // 2])) for t in texts]) < most


def test_fingerprint_takes_the_least_of_all():
    import tidemark.llm.fingerprints as module

    for n in (1, 2, 3, 24, 25, 100, 5000, 100_000):
        hashes = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
        ranks = hashes * module._multipliers(64)[:, None]
        want = np.argsort(ranks, axis=1)[:, :3]
        assert (module._least(hashes, 3, 64) == want).all()


def test_fingerprint_of_one_or_no_document(spark):
    assert compare_with_next(documents(spark, [])).count() == 0
    (row,) = compare_with_next(documents(spark, ["only one"])).collect()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == sha(edited("only one", "only one"))


# ---- archives


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    html = [None, "", "<p>\u00e9</p>\r\n\r\nWARC/1.1 inside", "same", "same", "x" * 100_000, "\n\n", "same"]
    rows = [(i, u, h) for i, (u, h) in enumerate(zip(["http://a/b c", None, "", "http://a/\n", "u", "u", "u", "u"], html))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash")).repartition(3)
    got = {r["page_id"]: tuple(r)[1:] for r in archives.archive_report(archives.archive_pages(df, version=version)).collect()}
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(i, best.get(h or "", 0))
    for i, _, h in rows:
        b = (h or "").encode()
        first = best[h or ""] == i
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""])
        assert got[i] == want


def test_archive_revisit_bound_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (3, "u", "long enough")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in archives.archive_report(archives.archive_pages(df, min_bytes=5)).collect())
    assert got[:2] == [(1, "response", None), (2, "response", None)]
    assert sorted(got[2:], key=str) == [(3, "response", None), (3, "revisit", 3)]


def test_foreign_arc_lines(spark, tmp_path):
    names = "1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n"
    body = b"HTTP/1.0 200 OK\nServer: x\n\nhi \xff"
    raw = f"filedesc://a.arc 0.0.0.0 19970101000000 text/plain {len(names)}\n{names}\n".encode()
    raw += b"http://a/ 1.2.3.4 19970203040506 text/html " + str(len(body)).encode() + b"\n" + body + b"\n" + b"broken line\nhttp://b/ 1.2.3.4 x text/plain 3\nraw\n"
    (tmp_path / "one.arc").write_bytes(raw)
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(raw[:100]) + gzip.compress(raw[100:]))
    got = archives.read_arc(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {bytes(r["payload"]) for r in got} == {b"hi \xff", b"raw"}
    assert {r["date"] for r in got} == {"1997-02-03T04:05:06Z", "1970-01-01T00:00:00Z"} and len({r["record_id"] for r in got}) == 4


def test_no_pages_no_records(spark):
    assert archives.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- byte-level BPE


def test_encoding_is_tiktokens(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [*awkward(), "<|endoftext|> I'm  you've 12\u00b2 \U0001f468\u200d\U0001f469 \u0e01\u0e33 \r\n\t x   ", "".join(map(chr, range(1, 0x3000))), " " * 999, "a" * 999, "\u200b\u2028\u0085\u00a0 z"]
    docs = docs.unionByName(documents(spark, odd, 100_000).select("doc_id", "text"))
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text"))
    for r in byte_bpe.encoding_report(byte_bpe.decode(encoded, RANKS)).join(docs, "doc_id").collect():
        ids = tok.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(r["text"] or "")


def test_offsets_and_split_characters(spark):
    text = "h\u00e9llo \U0001f600 w\u4e2drld"
    (row,) = byte_bpe.encode(documents(spark, [text]), RANKS, public_tokenizers.PATTERN, offsets=True).collect()
    strings = byte_bpe.byte_strings(open(RANKS, "rb").read())
    pieces = [strings[i] for i in row["ids"]]
    assert b"".join(pieces).decode() == text == "".join(byte_bpe.decode_pieces(iter(pieces)))
    assert row["starts"][0] == 0 and row["stops"][-1] == len(text) and all(a < b for a, b in zip(row["starts"], row["stops"]))
    assert "".join(byte_bpe.decode_pieces(iter([b"\xe4", b"\xb8", b"\xad", b"\xff"]))) == "\u4e2d\ufffd"
    assert byte_bpe.encode(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, may_learn=~toxicity.held_out(F.col("id")))
    rows = toxicity.score(docs.select("doc_id", "text"), model).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0]).mean()
    assert auc > 0.85 and (s[y == 0] >= 0.5).mean() < 0.02 and (s[y == 1] >= 0.5).mean() > 0.7


def test_swaps_lower_the_false_alarms_on_groups():
    vocabulary = {w: i for i, w in enumerate(["muslim", "christian", "idiot", "kind", "day", "book"])}
    rows = [["muslim", "idiot"], ["muslim", "idiot", "day"], ["idiot", "book"]] * 20 + [["christian", "day"], ["book", "kind"], ["day"], ["muslim", "kind"]] * 20
    x = [np.array(sorted(vocabulary[w] for w in r)) for r in rows]
    y = np.array([1] * 60 + [0] * 80, float)
    swaps = {0: 1, 1: 0}
    plain, _ = toxicity.train(x, y, swaps, 6, 0.0, 300)
    fair, bias = toxicity.train(x, y, swaps, 6, 20.0, 300)
    assert abs(fair[0] - fair[1]) < 0.2 * abs(plain[0] - plain[1])
    assert bias + fair[0] < 0 < bias + fair[2]


def test_toxicity_of_awkward_tables(spark):
    docs = documents(spark, [*awkward(), "you idiot", "idiot fool", "a kind day"]).withColumn("label", F.lit("clash")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(15, 1, 1), (16, 1, 1), (16, 1, 0), (17, 1, 0), (5, 1, 0), (10, 1, 0), (None, 1, 1), (3, 1, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["s"] for r in toxicity.score(docs, model, score_col="s").collect()}
    assert len(got) == docs.count() and all(0 <= v <= 1 for v in got.values()) and got[15] > got[17] and got[0] == got[1]
    assert 0 < toxicity.score(docs, toxicity.fit(docs, labels.limit(0)), score_col="s").first()["s"] < 1
    assert toxicity.score(docs.limit(0), model, score_col="s").count() == 0
    assert spark.sql("select cast(null as long) as i").select(toxicity.held_out(F.col("i"))).first()[0]


# ---- n-gram join


def components(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[p : p + 4]) for p in range(len(w) - 3)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def test_join_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = components([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, jaccard_components(docs).collect())) == want


def test_join_of_chains_and_awkward_rows(spark):
    texts = awkward()
    base = prose(11, 200).split(" ")
    for step in range(12):  # each differs a little from the one before, the last much from the first
        base = base[: step * 15] + [f"n{step}"] + base[step * 15 + 1 :]
        texts.append(" ".join(base))
    for step in range(30):  # near copies that share a passage at different similarities
        texts.append(" ".join(prose(20, 100).split(" ")[: 70 + step]) + " " + prose(100 + step, 12))
    texts += ["One two", "one  TWO", "one two three", "\u00c9t\u00e9 a b c", "\u00e9t\u00e9 a b c"]
    docs = documents(spark, texts).withColumn("digest", F.lit("clash")).withColumn("key", F.lit(1))
    assert sorted(map(tuple, jaccard_components(docs).collect())) == components(list(enumerate(texts)))
    assert jaccard_components(docs.limit(0)).count() == 0


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n, m in ((5, 6), (40, 45), (300, 280), (900, 1000)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, m - n // 2).astype(np.uint64)]))
        assert len(np.intersect1d(a, b)) <= overlap_bound(signature(a), len(a), signature(b), len(b)) <= min(len(a), len(b))


def test_linked_sets_share_a_key_and_random_ones_do_not():
    rng = np.random.default_rng(4)
    for percent in (60, 80, 85, 95):
        for n in (1, 4, 7, 12, 30, 75, 200, 530):
            base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            sets = [base]
            for _ in range(20):  # without some elements, with some others, or both
                kept = base[rng.random(len(base)) > rng.uniform(0, 1 - percent / 100)]
                more = rng.integers(0, 2**64, int(rng.integers(0, 1 + n * (100 - percent) // 100)), dtype=np.uint64)
                sets.append(np.unique(np.concatenate([kept, more])))
            sets += [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(5)]
            sets = [x for x in sets if len(x)]
            keys, owner = part_keys(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), percent)
            keys = [set(keys[owner == i].tolist()) for i in range(len(sets))]
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    shared = len(np.intersect1d(a, b))
                    if not np.array_equal(a, b) and 100 * shared >= percent * (len(a) + len(b) - shared):
                        assert keys[i] & keys[j]
            assert not any(a & b for i, a in enumerate(keys[-5:]) for b in keys[-5:][:i])


def test_large_groups_meet_tile_by_tile(spark, monkeypatch):
    import tidemark.llm.ngram_join as module

    monkeypatch.setattr(module, "TILE", 8)
    base, texts = prose(50, 120).split(" "), []
    for i in range(60):  # copies of one text about the least similarity apart: some pairs link, most do not
        words = list(base)
        for k in range(2 + i % 3):
            words[(i * 17 + k * 41) % 120] = f"w{i}x{k}"
        texts.append(" ".join(words))
    rows = []
    verified = module._verified
    monkeypatch.setattr(module, "_verified", lambda *a: rows.append(verified(*a)) or rows[-1])
    assert sorted(map(tuple, jaccard_components(documents(spark, texts)).collect())) == components(list(enumerate(texts)))
    # what leaves a comparison is a link a set, not a row a pair
    assert len(rows) == 2 + module.TURNS and rows[0].count() < len(texts)


def test_only_sets_that_may_link_are_grouped(spark, monkeypatch):
    import tidemark.llm.ngram_join as module

    shared = [prose(200 + k, 8) for k in range(4)]
    # texts of a few words with a line of others each: equal parts tie them together, no pair is similar
    texts = [" ".join([prose(300 + i, 6 + i % 5), shared[i % 4], shared[(i + 1 + i // 4) % 4]]) for i in range(80)]
    twins = [prose(700 + i, 60) for i in range(6)]
    texts += [t + end for t in twins for end in ("", " end")]
    wanted = []
    verified = module._verified
    monkeypatch.setattr(module, "_verified", lambda rows, sets, *a: wanted.append(sets.count()) or verified(rows, sets, *a))
    assert sorted(map(tuple, jaccard_components(documents(spark, texts)).collect())) == components(list(enumerate(texts)))
    assert wanted == [2 * len(twins)]


def test_sets_that_link_meet_enough_of_other_classes(spark):
    from tidemark.llm.ngram_join import _meeting, digest_of

    base = prose(60, 120).split(" ")
    texts = [" ".join(base[:i] + ["x%d" % i] + base[i + 1 :]) for i in range(0, 120, 10)] + [prose(90 + i, 1 + i) for i in range(30)]
    digests = [digest_of(x) for x in Sets(4).of(pa.array(texts))]
    alone, classes = set(digests[12:]), [1] * 12 + list(range(2, 32))
    for half in (True, False):
        rows = spark.createDataFrame([(t,) for t in texts], "text string")
        assert {r[0] for r in _meeting(rows, 4, 85, 5000, half).collect()} >= set(digests[:12])
    assert not {r[0] for r in _meeting(rows, 4, 85, 5000).collect()} & alone
    # sets of one class do not meet each other; of two classes they do
    for k, want in ((12, set()), (6, set(digests[:12]))):
        rows = spark.createDataFrame([(t, c if i < k or i >= 12 else 0) for i, (t, c) in enumerate(zip(texts, classes, strict=True))], "text string, class long")
        assert {r[0] for r in _meeting(rows, 4, 85, 5000).collect()} == want


def test_labels_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    got = {r[0]: r[1] for r in smallest_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in range(500, 600)}


# ---- decontamination


def weighted(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def tokens(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())


def leaks(docs, items):
    found = {}
    for d, t in docs:
        w = tokens(t)
        for i, q in items:
            v = tokens(q)
            if not v or not w:
                continue
            k = min(5, len(v))
            want = [tuple(v[p : p + k]) for p in range(len(v) - k + 1)]
            have = [tuple(w[p : p + k]) for p in range(len(w) - k + 1)]
            span = min(len(want), len(have))
            for p in range(len(have) - span + 1):
                s = weighted(have[p : p + span], want)
                if s >= 0.8 and s > found.get((d, i), (0,))[0]:
                    found[d, i] = (s, p)
    return found


def test_leaks_of_every_kind(spark):
    items = [prose(50 + i, 15 + 5 * i).replace("ß", "z") for i in range(6)] + ["one two three", "", None, "the the the the the the the"]
    edit = items[4].split(" ")
    edit[1] = "other"
    docs = [None, "", "x", prose(1, 80) + " %%% " + items[0].upper() + "!! " + prose(2, 50), " ".join(edit), items[3][:40], prose(3, 300), "zero one two three four", prose(4, 30) + " " + items[5] + " " + items[5], "the " * 50]
    table = documents(spark, docs).withColumn("found", F.lit(1)).withColumn("item_id", F.lit(5))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in find_contamination(table, bench).collect()}
    want = leaks(list(enumerate(docs)), list(enumerate(items)))
    assert got.keys() == want.keys() and {(3, 0), (4, 4), (8, 5), (7, 6)} <= got.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert find_contamination(table.limit(0), bench).count() == 0 == find_contamination(table, bench.limit(0)).count()


def test_leaks_of_the_small_table(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(docs, bench).collect()}
    assert got == set(leaks([(r[0], r[1]) for r in docs.collect()], [tuple(r) for r in bench.collect()]))


def test_parts_reach_the_radius():
    mark = simhash(np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rng = np.random.default_rng(1)
    for _ in range(200):
        other = mark
        for bit in rng.choice(64, 23, replace=False):
            other ^= 1 << int(bit)
        parts = [((mark >> 8 * p) & 255, (other >> 8 * p) & 255) for p in range(8)]
        assert any(b in variants(a, 8, 2) for a, b in parts)


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    words = prose(60, 40)
    texts = [prose(70 + i, 120) for i in range(6)] + [prose(70, 120), prose(71, 119), prose(80, 50) + " " + words + " " + prose(81, 50), None, "", "moron idiot scum trash", prose(72, 60) + " " + prose(90, 60)]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "1 as quality", "cast(text like '%idiot%' as int) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 6 not in got and 7 not in got and 8 not in got
    assert set(range(6)) <= set(got) and {9, 10, 12} <= set(got)
    assert got[12]["n_chars"] < len(texts[12]) and all(r["intact"] for r in got.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns, name


def test_near_copies_of_the_stage(spark, tmp_path):
    import corpus_pipeline

    a, b, new = ([f"{k}{i}" for i in range(200)] for k in "abn")
    # 196 shingles of five words: 196 / 245 is 0.80, 196 / 246 just below
    texts = [a, a + new[:49], b, b + new[100:150]]
    kept = corpus_pipeline.keep_one_of_each_group(spark, documents(spark, [" ".join(t) for t in texts]), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_schema_is_the_documents_schema():
    assert SCHEMA.startswith("doc_id long, text string")
