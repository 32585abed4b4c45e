"""URL filters: host and path rules, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chosen

#: Lengths of the character n-grams, and hash buckets that they fall into.
GRAMS = (3, 4, 5)
BUCKETS = 4096

#: Rules of the registered query, as (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Words of the small labelled URL table, each used in a few URLs.
UNWANTED = (
    "casino", "poker", "slots", "jackpot", "betting", "bets", "lottery", "roulette",
    "pills", "pharmacy", "viagra", "replica", "cheap", "loans", "payday", "bitcoin-win",
    "adult", "porn", "xxx", "escort", "camgirls", "ads", "adserver", "track",
    "tracker", "clickbait", "spam", "link-farm", "malware", "phishing", "warez", "free-gifts",
)
WANTED = (
    "wiki", "news", "docs", "library", "school", "university", "science", "museum",
    "weather", "recipes", "forum", "travel", "health", "research", "history", "books",
    "garden", "music", "sports", "city", "government", "archive", "journal", "theatre",
    "mountain", "kitchen", "teacher", "railway", "language", "physics", "gallery", "thread",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): a small table in shapes that both labels share; wanted words are used more often, as on the web."""
    shapes = ("https://{}.example.com/en/12", "http://www.{}.org/fr/345?page=2", "https://m.the-{}.net/de/6.html")
    more = ("http://blog.{}.example.org/es/78#top", "https://{}.example.net/en/9?utm_source=feed", "http://m.{}.example.com/de/1/")
    rows = [(shape.format(word), float(label)) for label, words, used in ((1, UNWANTED, shapes), (0, WANTED, shapes + more)) for word in words for shape in used]
    return spark.createDataFrame(rows, "url string, blocked double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/]*)", 1)
    upper = "".join(chr(c) for c in range(65, 91))
    return F.translate(host, upper, upper.lower()), F.substr(rest, F.char_length(host) + 1)


def buckets_of(host: Column, path: Column, grams: Sequence[int] = GRAMS, buckets: int = BUCKETS) -> Column:
    """Distinct hash buckets (from 1) of all character n-grams of host and path, apart for the two, with marks at the ends."""

    def cut(text: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))

    parts = [F.transform(cut(F.concat(F.lit("^"), text, F.lit("$")), n), lambda g, k=f"{kind}{n}": (F.pmod(F.xxhash64(F.lit(k), g), F.lit(buckets)) + 1).cast("int")) for kind, text in (("h", host), ("p", path)) for n in grams]
    return F.array_distinct(F.flatten(F.array(*parts)))


@dataclass(frozen=True)
class UrlModel:
    """One weight for each bucket; a fixed number of them, whatever is scored."""

    weights: tuple[float, ...]
    intercept: float
    grams: tuple[int, ...]

    def probability(self, host: Column, path: Column) -> Column:
        """Probability that the URL is unwanted: sums and lookups in one expression."""
        table = F.lit(list(self.weights))
        total = F.aggregate(buckets_of(host, path, self.grams, len(self.weights)), F.lit(self.intercept), lambda s, b: s + F.element_at(table, b))
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", grams: tuple[int, ...] = GRAMS, buckets: int = BUCKETS, ridge: float = 0.0005) -> UrlModel:
    """Fit on the small labelled table (both labels must occur); rows without a 0 or 1 label are left out."""
    rows = chosen(labelled, {"url": url_col, "label": label_col}).withColumn("label", F.col("label").cast("double")).where("label in (0, 1)")
    host, path = host_and_path(F.col("url"))
    # the buckets of each row are gathered first: inside the lambda they would be hashed anew for every element
    pairs = rows.select("label", "url", F.explode(buckets_of(host, path, grams, buckets)).alias("bucket"))
    found = pairs.groupBy("url", "label").agg(F.collect_set("bucket").alias("found"))
    dense = F.transform(F.sequence(F.lit(1), F.lit(buckets)), lambda i: F.array_contains("found", i).cast("double"))
    vectors = found.select("label", "url", array_to_vector(dense).alias("features")).coalesce(1).sortWithinPartitions("url", "label").cache()
    model = LogisticRegression(regParam=ridge, standardization=False, maxIter=200).fit(vectors)
    vectors.unpersist()
    return UrlModel(tuple(float(x) for x in model.coefficients), float(model.intercept), tuple(grams))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null.

    A rule is a host, then from the first slash a path start; it fits the host
    and its subdomains. The rule list is a parameter of fixed length and becomes
    one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of_host, slash, of_path = text.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(slash + of_path))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, p_blocked): the rule's verdict, else the model's at a half.

    Null URLs and URLs without ``://`` have an empty host and path, fit no rule
    and are judged by the model; repeated rows are judged alike; an empty table
    gives an empty one; other columns are left behind.
    """
    rows = chosen(pages, {"id": id_col, "url": url_col})
    host, path = host_and_path(F.col("url"))
    split = rows.select("id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    scored = split.select("*", rule.alias("rule"), verdict.alias("said"), model.probability(F.col("host"), F.col("path")).alias("p_blocked"))
    by_model = F.when(F.col("p_blocked") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"), "p_blocked")
