"""Documents that every operator must take: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of great strength and hidden power"


def documents(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, langs[k] if langs else "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "\n\n", "one", "a b c d", "x" * 30_000, " ".join(f"w{k}" for k in range(20_000)), PROSE, PROSE, "tab\there\x0bvt nbsp x ▁mark 漢字 😀 é", "\x1c\x1f\x00 odd"]


def odd_frame(spark):
    """The odd texts, one of them twice under one id, and columns named like what operators add."""
    base = documents(spark, ODD)
    return base.unionByName(base.where("doc_id = 9")).selectExpr("*", "'mine' AS ids", "'mine' AS decoded", "1 AS secrets", "2 AS leaks", "3 AS score", "4 AS n_words", "5 AS key", "6 AS comp")
