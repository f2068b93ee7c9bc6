"""Readers and writers of files: chat exports, passports, results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import roots
from ..operators.numbering import numbered
from .store import Store

MESSAGE = "struct<id:bigint,type:string,date:string,from:string,text:string,reply_to_message_id:bigint>"


def chat_entries(spark: SparkSession, path: str) -> DataFrame:
    """chat_id, pos, ext_id, sent_at, author, text, reply_to, is_message, is_text of all entries of chat exports in their order; service entries are no messages, those without text no texts."""
    rows = spark.read.schema(f"id bigint, messages array<{MESSAGE}>").json(path).select(F.col("id").alias("chat_id"), F.posexplode("messages").alias("pos", "m"))
    is_message = F.coalesce(F.col("m.type") == "message", F.lit(False))
    is_text = is_message & F.coalesce(F.col("m.text") != "", F.lit(False))
    return rows.select("chat_id", "pos", F.col("m.id").alias("ext_id"), F.try_to_timestamp("m.date").alias("sent_at"), F.col("m.from").alias("author"), "m.text", F.col("m.reply_to_message_id").alias("reply_to"), is_message.alias("is_message"), is_text.alias("is_text"))


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """``chat_entries`` that are texts."""
    return chat_entries(spark, path).filter("is_text").drop("pos", "is_message", "is_text")


def packet(entries: DataFrame, first: str | None = None, last: str | None = None, most: int | None = None, threads: bool = True) -> DataFrame:
    """chat_id, source_ref, ext_id, post_ref, author, sent_at, text of the messages of ``chat_entries`` from the day ``first`` to the day ``last``.

    With ``threads`` a reply is a comment on the message that its chain of parents begins with, if that is a text and all of the chain is in the period;
    other texts are posts. Posts are numbered in their order (P0001), ``most`` of a chat at most; comments of each post likewise (P0001.C0001), and go with their post.
    """
    day = F.to_date("sent_at")
    rows = entries.filter("is_message")
    rows = rows if first is None else rows.filter(day >= F.lit(first).cast("date"))
    rows = rows if last is None else rows.filter(day <= F.lit(last).cast("date"))
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", "chat_id", c))
    rows = rows.withColumns({"id": key("ext_id"), "parent": key("reply_to")})
    texts = rows.filter("is_text")
    texts = texts.join(roots(rows.select("id", "parent", "is_text")), "id") if threads else texts.withColumn("root", F.col("id"))
    order = [F.col("pos")]
    number = lambda letter, c: F.concat(F.lit(letter), F.lpad(F.col(c).cast("string"), F.greatest(F.lit(4), F.length(F.col(c).cast("string"))), F.lit("0")))
    posts = numbered(texts.filter("root = id"), "chat_id", order, F.floor(F.col("pos") / 10_000), "n")
    posts = posts if most is None else posts.filter(F.col("n") <= most)
    posts = posts.withColumn("post_ref", number("P", "n"))
    said = texts.filter("root <> id").join(posts.select(F.col("id").alias("root"), "post_ref"), "root")
    said = numbered(said, "root", order, F.floor(F.col("pos") / 10_000), "n").withColumn("source_ref", F.concat("post_ref", F.lit("."), number("C", "n")))
    names = ("chat_id", "source_ref", "ext_id", "post_ref", "author", "sent_at", "text")
    return posts.withColumn("source_ref", F.col("post_ref")).select(*names).unionByName(said.select(*names))


def accepted(passports: DataFrame, manifest: DataFrame) -> DataFrame:
    return passports.join(manifest.filter("verdict = 'accepted' OR include").select("source_id"), "source_id", "left_semi")


def write_result(df: DataFrame, folder: str, request_id: str) -> str:
    """Write a result as JSON under its request's id, which must be safe as a file's name, and make it the one that ``read_result`` gives; until then the one before is, without a moment between. The path of its files."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", request_id):
        raise ValueError("not a request id")
    store = Store(df.sparkSession, f"{folder}/{request_id}", "json")
    store.publish(replace={"result": df})
    return store.segments("result")[0]


def read_result(spark: SparkSession, folder: str, request_id: str) -> DataFrame:
    """The last result that was written whole."""
    return Store(spark, f"{folder}/{request_id}", "json").read("result")


#: Columns of the index of a result's sources, in their order.
INDEX = (
    "source_key", "expert_id", "telegram_message_id", "relevance", "created_at", "reason", "evidence_depth", "source_type", "comment_signal", "confidence",
    "external_links_count", "author_comments_count", "community_comments_count", "linked_context_count", "content_chars",
)


def index_rows(rows: DataFrame, place: str) -> DataFrame:
    """The cells of the index of ``rows`` (INDEX and ``place``, the order in which sources are listed): each key once, where it is first; tabs and ends of lines are spaces, nulls are empty. Rows without a key go."""
    first = F.min_by(F.struct(*INDEX), F.col(place)).alias("r")
    once = rows.filter("source_key IS NOT NULL AND source_key <> ''").groupBy(F.col("source_key").alias("k")).agg(first).select("r.*")
    return once.select(*(F.coalesce(F.trim(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ")), F.lit("")).alias(c) for c in INDEX))


def write_index(rows: DataFrame, place: str, path: str) -> None:
    """``index_rows`` as tab-separated files with a line of names; nothing is quoted, since no cell has a tab."""
    index_rows(rows, place).write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


SEGMENT = "struct<segment_id:bigint,topic_id:string,title:string>"


def video_segments(spark: SparkSession, path: str) -> DataFrame:
    """url, segment_id, title, video_id, topic_id of video exports: ids of URL and segment, topics of URL and topic (``general`` without one)."""
    rows = spark.read.schema(f"video_metadata struct<url:string>, segments array<{SEGMENT}>").json(path)
    rows = rows.select(F.coalesce("video_metadata.url", F.lit("unknown_url")).alias("url"), F.posexplode("segments").alias("pos", "s"))
    own = F.coalesce("s.segment_id", "pos")
    topic = F.concat_ws("_", F.substring(F.md5("url"), 1, 12), F.coalesce("s.topic_id", F.lit("general")))
    return rows.select("url", own.alias("segment_id"), F.col("s.title").alias("title"), hash_id(F.concat_ws("_", "url", own)).alias("video_id"), topic.alias("topic_id"))


def hash_id(text: Column, modulus: int = 1_000_000_000) -> Column:
    """The md5 of a text as a number of 128 bits, modulo ``modulus``: by 32 bits at a time, each of which fits in a long."""
    h, out = F.md5(text.cast("binary")), F.lit(0).cast("long")
    for i in (1, 9, 17, 25):
        out = (out * (1 << 32) + F.conv(F.substring(h, i, 8), 16, 10).cast("long")) % modulus
    return out


def results(spark: SparkSession, path: str) -> DataFrame:
    """request_id, sources, experts (with main sources and a digest) of results of requests."""
    key = "array<struct<source_key:string>>"
    return spark.read.schema(f"request_id bigint, sources array<struct<expert_id:string,source_key:string>>, experts array<struct<expert_id:string,main_sources:{key},digest:struct<source_refs:{key},source_index:{key}>>>").json(path)
