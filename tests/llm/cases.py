"""Awkward rows that every document operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
    T.StructField("stats", T.StringType()), T.StructField("hash", T.LongType()),
])

LONG = " ".join(f"word{i % 97} line{i % 89}" for i in range(6000))
TEXTS = [
    None, "", "   \n\t ", "one", "a b c", "a b c a b c a b c", "täg größe 日本語 \U0001f600 naïve", "same line\nsame line\nother\n\nsame line",
    LONG, LONG, "x" * 5000, "#*$%& |<> ### tok", "UPPER CASE WORDS HERE", 'password = "hunter2hunter2" and AKIAABCDEFGHIJKL0 ' + "ab12" * 10,
    "token: secret: abcdefgh12 api_key=short token=abc", "the quick brown fox jumps over the lazy dog " * 12, "\x0b\x0c odd\x0bspace\x0c", "<|endoftext|> special <|endoftext|>",
]


def rows():
    out = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s3"][i % 4], None, "clash", "clash", i) for i, t in enumerate(TEXTS)]
    return [*out, (None, "null id text here", None, None, None, None, None, None), (3, "one", "en", "s3", 3, None, None, 1)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
