"""The registered queries of this subpackage and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import archives, byte_bpe, hard_negatives, language_id, toxicity, url_filter, vector_codes
from tidemark.llm.common import table
from tidemark.llm.debruijn import remove_repeated_words, word_removal_report
from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.fingerprints import compare_with_next
from tidemark.llm.licenses import scan_licences
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.suffix_dedup import removal_report, remove_repeats


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file ``source/block/name``; the first twenty ids of a block of 200 are its licence files."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 200 < 20, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 200).cast("string"), name)
    found = scan_licences(docs, "doc_id", path)
    return found.withColumn("own_score", F.round("own_score", 6))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_report(archives.archive_pages(table(spark, sf_dir, "pages")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encoding_report(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), may_learn=~toxicity.held_out(F.col("id")))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(remove_repeats(table(spark, sf_dir, "documents")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_removal_report(remove_repeated_words(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, may_learn=~toxicity.held_out(F.col("id")))
    found = language_id.predict(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_url_filters": op2_url_filters,
    "op3_fingerprints": op3_fingerprints,
    "op4_warc": op4_warc,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_join": op7_ngram_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_language_id": op11_language_id,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}

#: Vectors with finite components only.
_FINITE = "embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"


def _codebook_sql(rounds: int = 6) -> str:
    """Exact nearest entries: the distance times 16 plus the index, so that the smallest number has both."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, [floor(4096 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT vec_id, k, q[len(q) // 8 * k + 1 : len(q) // 8 * (k + 1)] AS x FROM v, range(8) r(k)),
b0 AS MATERIALIZED (SELECT k, e, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 16) USING (vec_id))"""
    ]
    near = "SELECT p.vec_id, p.k, p.x, CAST(min(16 * (list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x)) + e) AS BIGINT) AS m FROM p JOIN b{} b ON p.k = b.k GROUP BY ALL"
    for n in range(rounds):
        steps.append(
            f"""a{n} AS MATERIALIZED ({near.format(n)}),
t{n} AS (SELECT k, m % 16 AS e, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM a{n}),
s{n} AS (SELECT k, e, list(m ORDER BY i) AS x FROM (SELECT k, e, i, floor(CAST(sum(c) AS BIGINT) / count(*)) AS m FROM t{n} GROUP BY ALL) GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT k, e, coalesce(s{n}.x, b{n}.x) AS x FROM b{n} LEFT JOIN s{n} USING (k, e))"""
        )
    tail = f"""a AS MATERIALIZED ({near.format(rounds)}),
c AS (SELECT vec_id, string_agg(format('{{:02x}}', m % 16), '' ORDER BY k) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string([CAST(y AS BIGINT) for y in x], ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h"""
    return "WITH " + ",\n".join([*steps, tail])


_WORDS = r"'[^\x20\x09-\x0D]+'"

SQL: dict[str, str] = {
    "op4_warc": """WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS last FROM d GROUP BY 1)
SELECT page_id, CAST(strlen(d.html) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31), 1) for k in range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM d JOIN m USING (html)""",
    "op7_ngram_join": f"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i : i + 3], ' ') for i in range(1, len(ws) - 2)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON s.doc_id = r.a GROUP BY 1, 2""",
    "op8_suffix_dedup": """WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
u AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(h, '(..)', '\\1 ', 'g'), ' ')[: len(h) // 2]) AS b, unnest(range(0, len(h) // 2)) AS p FROM w),
k AS (SELECT doc_id, p, string_agg(b, '') OVER f AS x, count(*) OVER f AS n FROM u
      WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
f AS (SELECT x, min(doc_id) AS d FROM k WHERE n = 50 GROUP BY x),
m AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM k JOIN f USING (x) WHERE n = 50 AND doc_id > d),
g AS (SELECT doc_id, count(*) AS gone, count(*) FILTER (WHERE p - before IS DISTINCT FROM 1) AS spans
      FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM m) GROUP BY 1),
y AS (SELECT u.doc_id, string_agg(b, '' ORDER BY u.p) AS kept FROM u LEFT JOIN m ON u.doc_id = m.doc_id AND u.p = m.p WHERE m.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op9_substring_dedup": f"""WITH
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT doc_id, j, string_agg(word, ' ') OVER f AS x, count(*) OVER f AS n FROM u
      WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
c AS (SELECT x FROM k WHERE n = 35 GROUP BY x HAVING count(*) > 1),
m AS (SELECT DISTINCT doc_id, unnest(range(j, j + 35)) AS j FROM k JOIN c USING (x) WHERE n = 35),
g AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) FILTER (WHERE m.j IS NULL) AS kept, count(m.j) AS gone FROM u LEFT JOIN m ON u.doc_id = m.doc_id AND u.j = m.j GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)""",
    "op12_hard_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
      FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3""",
    "op13_vector_codes": _codebook_sql(),
}
