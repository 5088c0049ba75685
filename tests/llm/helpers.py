"""Brute force over single texts, for small fixtures."""

import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"
#: Rows every operator must take: nulls, empty and white texts, repeated rows, odd characters, a long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "..."), (5, "one"), (5, "one"), (None, "no id at all"), (7, "Été ÀÉ 中文 naïve"), (8, "a" * 5000), (9, "word " * 5000), (10, "é😀" * 300),
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORDS.findall(lower(text))


def clashing(df):
    """The same rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["key", "n", "norm", "shard", "row", "group", "score", "sha256", "set_key", "part", "h", "kept", "words", "_m", "held", "length"]
    return df.select("*", *(F.lit("x").alias(c) for c in names))
