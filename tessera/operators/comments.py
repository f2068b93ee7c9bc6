"""Comments and thread topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_author(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments (doc_id, comment_id, author_id) with ``side``: 'author' where the comment's author is the post's (without the prefix 'channel'), 'community' where it isn't; a comment without author is on neither side, and all are community if the post has none."""
    own = posts.select("doc_id", F.regexp_replace("post_author", "^channel", "").alias("own"))
    joined = comments.join(own, "doc_id")
    same = F.col("author_id") == F.col("own")
    return joined.withColumn("side", F.when(F.col("own").isNull(), "community").when(same, "author").when(~same, "community"))


def capped(comments: DataFrame, k: int) -> DataFrame:
    """The first k comments of each document, the author's before the community's."""
    side = F.when(F.col("kind") == "author", 0).when(F.col("kind") == "community", 1).otherwise(2)
    return comments.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(side, "comment_id"))).filter(F.col("place") <= k)


def topic_text(topic: Column) -> Column:
    """Topic, keywords, phrases and context in one text; what is missing is left out."""
    return F.concat_ws(" ", topic["topic"], F.array_join(topic["keywords"], " "), F.array_join(topic["key_phrases"], " "), topic["context"])


def parsed_topics(text: Column) -> Column:
    """Topics of JSON that is an object with ``drift_topics`` (also doubly so) or a list, repaired if it doesn't parse; null where it is neither."""
    kind = "array<struct<topic:string,keywords:array<string>,key_phrases:array<string>,context:string>>"
    text = repaired_json(F.regexp_replace(text, r'\\(?![ntr"\\/])', ""))
    inner = F.get_json_object(text, "$.drift_topics.drift_topics")
    outer = F.get_json_object(text, "$.drift_topics")
    return F.coalesce(F.from_json(inner, kind), F.from_json(outer, kind), F.when(F.ltrim(text).startswith("["), F.from_json(text, kind)))


def unnested(text: Column) -> Column:
    """JSON of topics that are nested twice, with one level; any other text as it is."""
    inner = F.get_json_object(text, "$.drift_topics.drift_topics")
    return F.when(inner.isNotNull(), F.concat(F.lit('{"drift_topics":'), inner, F.lit("}"))).otherwise(text)


def thread_groups(groups: DataFrame, posts: DataFrame, comments: DataFrame, cutoff: str | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """doc_id, topics (parsed; empty if there are none), n_comments of the groups (doc_id, drifted, topics as JSON) that drifted from their post (doc_id, created_at), unless it is older than ``cutoff`` or ``excluded`` (doc_id)."""
    recent = posts if cutoff is None else posts.filter(F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz"))
    rows = groups.filter("drifted").join(recent.select("doc_id"), "doc_id")
    if excluded is not None:
        rows = rows.join(excluded.select("doc_id"), "doc_id", "left_anti")
    by = comments.groupBy("doc_id").agg(F.count("*").alias("n_comments"))
    topics = parsed_topics(F.col("topics"))
    return rows.join(by, "doc_id", "left").select("doc_id", F.filter(F.coalesce(topics, F.array()), lambda t: t.isNotNull()).alias("topics"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"))


def backfilled(groups: DataFrame, most: int, embedder) -> DataFrame:
    """doc_id, embedding of the next ``most`` groups (doc_id, drifted, topics as JSON, embedding) that drifted and have topics but no vector, in order of the id."""
    text = F.array_join(F.transform(parsed_topics(F.col("topics")), topic_text), " ")
    rows = groups.filter("drifted AND topics IS NOT NULL AND embedding IS NULL").select("doc_id", text.alias("text"))
    return rows.filter("text <> ''").orderBy("doc_id").limit(most).select("doc_id", embedder(F.col("text")).alias("embedding"))


def normalised(vector: Column) -> Column:
    """The vector over its norm; null if it is zero, or holds null or non-finite components."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0)
    return F.when(fine, F.transform(vector, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def similar_topics(groups: DataFrame, target: list[float], k: int = 20, least: float = 0.75) -> DataFrame:
    """Of groups (group_id, source_id, created_at, embedding of unit length) each source's k most similar, then those that reach ``least``, newest first."""
    rows = groups.filter((F.size("embedding") == len(target)) & F.col("embedding").isNotNull()).withColumn("similarity", dot(F.col("embedding"), F.array(*map(F.lit, target))))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("similarity"), "group_id"))).filter(F.col("rank") <= k)
    return best.filter(F.col("similarity") >= least)


def dispatched(groups: DataFrame, target: list[float], scorer, k: int = 20, least: float = 0.75) -> DataFrame:
    """source_id, group_id, path, score: by vectors where all groups of a source have one, else by what ``scorer`` gives for the text of their topics (above 0). Columns as of ``similar_topics``, and text."""
    rows = groups.join(groups.groupBy("source_id").agg(F.bool_and(F.col("embedding").isNotNull()).alias("whole")), "source_id")
    near = similar_topics(rows.filter("whole"), target, k, least).select("source_id", "group_id", F.lit("vectors").alias("path"), F.col("similarity").alias("score"))
    read = rows.filter("NOT whole").select("source_id", "group_id", F.lit("texts").alias("path"), scorer(F.col("text")).cast("double").alias("score"))
    return near.unionByName(read.filter("score > 0"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert of a table by rewriting it."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def repaired_json(text: Column) -> Column:
    """The JSON text as it is if it parses, else without a code fence around it and with bare keys quoted if that parses, else null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*```[a-z]*\s*", ""), r"\s*```\s*$", "")
    quoted = F.regexp_replace(bare, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    valid = lambda t: F.try_parse_json(t).isNotNull()
    return F.when(valid(text), text).when(valid(bare), bare).when(valid(quoted), quoted)
