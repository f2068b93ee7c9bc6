"""The corpus pipeline: five stages, each written as Parquet and read again by the next one.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``. In turn: toxic documents go; lines of
passages that were there before go from a text; one document of each group of
near-duplicates stays; sources are mixed to their targets, a document being there as often
as it is taken; what is left is encoded, one row for each taken document.

Defined cases: a null text is empty; rows without an id and repeated rows do no harm; columns beside those
of ``documents``, whatever their names, are kept by all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash, mixing, sentencepiece_scan, toxicity
from tessera.llm.storage import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold of toxicity, learnt from the labels of those that are here."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of passages that were there before."""
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of each source that its target takes, as often as it does."""
    return mixing.take(docs, share=1.5, max_epochs=2.0)


#: Fewer than by default: here a Python worker still holds what the stages before it loaded.
REMEMBERED = 100_000


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document."""
    return sentencepiece_scan.encode(docs, remembered=REMEMBERED).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: MinHash, the toxicity model and the pieces have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
