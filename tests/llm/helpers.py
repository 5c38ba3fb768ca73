"""Tables for the edge cases that every operator has to meet."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the names of results."""
    long = " ".join(f"word{i % 997} some text here" for i in range(20_000))
    rows = [(1, "plain text of a few words here", "en"), (2, None, "en"), (3, "", "en"), (4, "  \n\t ", None), (None, "no id at all in this row", "en"), (5, long, "en"), (6, "same text twice in the table now", "en")]
    rows += [(6, "same text twice in the table now", "en"), (7, "ひらがな кириллица ελληνικά \U0001f600 \x00 end", None), (8, "!!! 123 ???", "en")]
    d = spark.createDataFrame([(i, t, g, "s", None) for i, t, g in rows], DOCS)
    from pyspark.sql import functions as F

    return d.withColumns({c: F.lit("mine") for c in ("score", "ids", "n_bytes", "key", "sig", "n", "rid", "word", "kept", "text2")})


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))
