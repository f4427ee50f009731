"""A corpus pipeline of five operators over the documents table.

Each stage takes all that the one before kept, written as Parquet and read again; all but the last return the columns of
documents, further ones too, whatever their names.  A stage works on the documents it is given; benchmark and labels come from the folder of
the tables.  Null and empty texts are never rejected and are no copies of one another; null doc_ids stay; of rows with the same doc_id and
text (with words) one stays, and rows that share a doc_id but not the text are documents of their own.  Among near copies the smallest
doc_id stays, ties going by the text's digest.  Texts are read whole whatever their length; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hduframe.llm import decontaminate, near_dedup, secrets, sentencepiece_codec, toxicity
from hduframe.llm.common import Scratch, unused
from hduframe.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return toxicity.score(spark, docs, machine, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; documents without words all stay."""
    table(spark, sf_dir, "documents")
    return near_dedup.survivors(spark, docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = unused(docs, "leaks")
    return decontaminate.scan(spark, docs, table(spark, sf_dir, "benchmark"), leaks).where(F.size(leaks) == 0).drop(leaks)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, and n_chars as the text is then."""
    table(spark, sf_dir, "documents")
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding gives the text back."""
    table(spark, sf_dir, "documents")
    done = sentencepiece_codec.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer("piece_bpe_32k.model"))
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("reversible"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_leaked),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: SQL can't express the stages' models and searches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
