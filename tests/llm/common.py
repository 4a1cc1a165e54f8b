"""Rows that every operator of documents must bear."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog and runs away " * 3000
ODD = [
    (1, "The cat sat on the mat and the dog sat on the log near the house.", "en", "a", 65),
    (1, "The cat sat on the mat and the dog sat on the log near the house.", "en", "a", 65),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, " \t\n\x0b\x0c\r ", "de", "b", 6),
    (5, LONG, "en", "b", len(LONG)),
    (6, "x" * 150_000, None, "c", 150_000),
    (7, "日本語 テキスト é ß 👍🏽 " * 5, "ja", "c", None),
    (None, "no id here but words enough to make a few shingles of it", "en", "a", None),
    (8, "12 34 ### $$$ !!!", "en", "a", 17),
]


def odd(spark):
    """The rows with columns whose names operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("id", "size", "key", "block", "node", "_id", "_text", "words", "vals", "rank", "train", "copies", "target", "m", "text_md5"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
