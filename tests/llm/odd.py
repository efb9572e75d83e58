"""Documents of all the odd kinds, with extra columns of names that the
operators use themselves."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["tox", "score", "rep", "ids", "set_id", "sig", "block", "a", "b", "root", "key", "no", "copy_of", "_leaked", "item_id", "page_id", "jaccard", "host", "s", "Score_"]


def texts():
    long = " ".join(f"word{i} and more" for i in range(9000))
    return [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
        (3, None, "en", "a", None),
        (4, "", "en", "a", 0),
        (5, "   \n\t ", None, None, 6),
        (None, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
        (None, None, None, None, None),
        (6, long, "en", "b", len(long)),
        (7, "x" * 200_000, "en", "b", 200_000),
        (8, "word", "en", "b", 4),
        (9, "日本語 テキスト 😀 \u0000 end", "ja", "c", 16),
    ]


def documents(spark, rows=None):
    df = spark.createDataFrame(texts() if rows is None else rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("extra"))
    return df


def plain(spark, rows):
    """Documents of (id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
