"""The logical tables of the engine over the driver's parquet tables.

Times are without zone; ``AS_OF`` stands for the time of a query, so that results don't
depend on the clock. Every reader names its columns, so scans read no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Files

AS_OF = "2025-12-31 00:00:00"
#: SQL of the same logical tables, for the oracles.
DOCS_SQL = """docs AS (SELECT doc_id, text, lang, source AS source_id, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id * 37 % 700 AS INT)) AS created_at,
  length(text) AS n, doc_id * 7 % 50 AS views, doc_id * 3 % 11 AS forwards FROM documents)"""
COMMENTS_SQL = """comments AS (SELECT conv_id AS doc_id, turn AS comment_id, role, text AS comment_text,
  CASE role WHEN 'assistant' THEN 'author' WHEN 'user' THEN 'community' ELSE 'other' END AS kind FROM conversations)"""
LINKS_SQL = """n AS (SELECT count(*) AS n FROM documents), links AS (SELECT doc_id AS src, (doc_id + 20 * (doc_id % 7 + 1)) % n AS dst,
  CASE doc_id % 3 WHEN 0 THEN 'reply' WHEN 1 THEN 'forward' ELSE 'mention' END AS kind FROM documents, n)"""


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it comes in fewer partitions, as a small table in one row group does: for work on texts that costs much more than dealing them. Larger tables stay in the tasks that read them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source_id, created_at, n (characters), views, forwards."""
    day = F.expr("timestampadd(DAY, CAST(doc_id * 37 % 700 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    return raw(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.col("source").alias("source_id"), day.alias("created_at"), F.char_length("text").alias("n"),
        (F.col("doc_id") * 7 % 50).alias("views"), (F.col("doc_id") * 3 % 11).alias("forwards"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, comment_id, role, comment_text, kind: an assistant is the document's author, a user the community."""
    kind = F.when(F.col("role") == "assistant", "author").when(F.col("role") == "user", "community").otherwise("other")
    return raw(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("comment_id"), "role", F.col("text").alias("comment_text"), kind.alias("kind"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind: one directed link of each document."""
    ids = raw(spark, sf_dir, "documents").select("doc_id")
    n = ids.agg(F.count("*").alias("n"))
    kind = F.when(F.col("doc_id") % 3 == 0, "reply").when(F.col("doc_id") % 3 == 1, "forward").otherwise("mention")
    return ids.crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("src"), ((F.col("doc_id") + 20 * (F.col("doc_id") % 7 + 1)) % F.col("n")).alias("dst"), kind.alias("kind"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def tables_in(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parquet tables of a folder (files or folders named ``x.parquet``), by name, as they are there now."""
    names = sorted(n.removesuffix(".parquet") for n in Files(spark, folder).names(folder) if n.endswith(".parquet"))
    return {n: raw(spark, folder, n) for n in names}


def catalogued(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """The tables of a database of the session's catalog, without temporary views."""
    return {t.name: spark.table(f"{'.'.join(t.namespace)}.{t.name}") for t in spark.catalog.listTables(database) if not t.isTemporary}


def counted(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table: one job, which reads no column."""
    out = spark.createDataFrame([], "name string, n long")
    for name, rows in tables.items():
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return out
