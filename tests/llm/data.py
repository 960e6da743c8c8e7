"""Small tables with all that may go wrong."""

from pyspark.sql import functions as F

LONG = "word " * 3000 + "x" * 20_000 + " der Text geht weiter und weiter " * 400
SPEC = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 66),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \t\n\x0b", "de", None, 4),
    (5, LONG, "de", "b", len(LONG)),
    (6, "The quick brown fox jumps over the lazy dog and runs away from it.", None, None, 66),
    (7, "one two", "en", "b", 7),
    (7, "one two", "en", "b", 7),
    (None, "no id here at all", "en", "b", 17),
    (9, "émigré naïve ﬁ \U0001f600 ünïcödé 数据 text", "fr", "ü", 30),
    (10, "don't <|endoftext|> stop", "en", "a", 24),
]


def edge(spark):
    """Nulls, blanks, long texts, repeated rows, and further columns whose names operators use themselves."""
    docs = spark.createDataFrame(ROWS, SPEC)
    for name in ("size", "kept", "n_words", "shard", "slot", "key", "_n", "_k", "host", "text_crc32", "piece", "rank", "score", "_copy", "_slice"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def empty(spark):
    return edge(spark).limit(0)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
