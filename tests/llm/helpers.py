"""Small tables with the awkward rows that every operator must take."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def awkward():
    """Nulls, empty and blank texts, one word, repeats, a long text without spaces, control characters, copies."""
    long = prose(7, 3000)
    near = long.split(" ")
    near[50] = "changed"
    return [
        None,
        "",
        " \t\n",
        "word",
        "word",
        long,
        long,
        " ".join(near),
        "x" * 5000,
        "a b " * 300,
        prose(1, 40) + " " + prose(2, 60),
        prose(3, 30) + "\n" + prose(2, 60) + " 中文 " + prose(4, 20),
        "nul \x00 and \x1f marks   here",
        prose(5, 500).upper(),
        prose(5, 500),
    ]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
