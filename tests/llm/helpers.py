"""Small tables with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=True):
    """rows: (doc_id, text, source). extra: columns whose names clash with those that operators make."""
    d = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in ("n_words", "kept", "size", "name", "text_", "digest", "m", "rank", "h", "copies", "row", "b"):
            d = d.withColumn(c, F.lit("x"))
    return d


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.2 else f"w{r.randrange(vocabulary)}" for _ in range(n))


def hard_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, repeated and null ids, odd characters."""
    long = words(1, 6000, 3000)
    return [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (5, "one", "b"), (6, long, "b"), (7, words(2, 120), "a"), (7, words(2, 120), "a"),
        (7, words(2, 120), "a"), (None, words(3, 80), None), (None, None, None), (8, words(2, 119) + " other", "c"), (9, "é🎉漢 " * 90, "c"), (10, words(4, 60) + "\n" + words(4, 60), "c"),
        (11, "a\x00b </s> <|endoftext|> [INST]" * 10, "d"),
    ]
