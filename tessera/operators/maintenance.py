"""Sync, retention and integrity: deletes and updates are rewrites by semi- and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .numbering import numbered


def linked_to(ids: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id of everything that a link of either direction ties to one of ``ids``."""
    own = ids.select("doc_id")
    out = links.join(own, F.col("src") == F.col("doc_id"), "left_semi").select(F.col("dst").alias("doc_id"))
    back = links.join(own, F.col("dst") == F.col("doc_id"), "left_semi").select(F.col("src").alias("doc_id"))
    return out.unionByName(back).distinct()


def prune_buckets(docs: DataFrame, links: DataFrame, cutoff: str) -> DataFrame:
    """``docs`` with ``bucket``: new from the cutoff on, linked if old but tied to a new one, else delete."""
    new = docs.filter(F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz"))
    tied = linked_to(new, links).select("doc_id", F.lit(True).alias("tied"))
    is_new = F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz")
    return docs.join(tied, "doc_id", "left").withColumn("bucket", F.when(is_new, "new").when(F.col("tied"), "linked").otherwise("delete")).drop("tied")


def orphans(child: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key no parent has; null keys are orphans too."""
    return child.join(parents.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def roots(messages: DataFrame) -> DataFrame:
    """id, root of messages (id, parent, is_text): the message that the chain of parents ends with, if that is a text; the message itself if it isn't, if a parent is missing, or if the chain runs into a cycle.

    Pointers are doubled until every way has ended or a round ends no more of them (what is left then runs into
    cycles), so a chain of n messages takes log2(n) joins; each round's pointers are written.
    """

    def left(state: DataFrame) -> int:
        return state.filter("NOT ended").select(F.count_distinct("id")).first()[0]

    known = messages.select(F.col("id").alias("k"))
    first = messages.join(known, F.col("parent") == F.col("k"), "left")
    state = written(first.select("id", F.coalesce("k", "id").alias("at"), F.col("k").isNull().alias("ended"), (F.col("parent").isNull() & F.coalesce("is_text", F.lit(False))).alias("good")), "roots")
    open_ways, before = left(state), None
    while open_ways and open_ways != before:
        up = state.select(F.col("id").alias("m"), F.col("at").alias("next"), F.col("ended").alias("end"), F.col("good").alias("fine"))
        state = written(state.join(up, F.col("at") == F.col("m")).select("id", F.col("next").alias("at"), F.col("end").alias("ended"), F.col("fine").alias("good")), "roots")
        before, open_ways = open_ways, left(state)
    return state.select("id", F.when(F.col("ended") & F.col("good"), F.col("at")).otherwise(F.col("id")).alias("root"))


def prioritised(parts: list[DataFrame], key: str) -> DataFrame:
    """The parts one after another; of rows of equal key those of the first part that has it."""
    rows = [p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("priority"))).filter("__n = 1").drop("__n")


def diff_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((old, "before"), (new, "after")))
    both = a.join(b, key, "full").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("removed", F.col("before") - F.col("after")).filter("removed > 0")


def within(seconds: Column, window: int, by: str) -> Column:
    """How many rows of the key come in the ``window`` seconds up to each, itself included."""
    return F.count("*").over(Window.partitionBy(by).orderBy(seconds).rangeBetween(-window + 1, 0))


def above(docs: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """``docs`` (doc_id, source_id) above the marks (source_id, mark) of their sources, with ``batch``: oldest first, ``size`` a batch. A source without a mark is all new."""
    known = marks.select("source_id", "mark")
    new = docs.join(known, "source_id", "left").filter("mark IS NULL OR doc_id > mark").drop("mark")
    placed = numbered(new, "source_id", [F.col("doc_id")], F.floor(F.col("doc_id") / 100_000), "__place")
    return placed.withColumn("batch", F.floor((F.col("__place") - 1) / size).cast("long")).drop("__place")


def advanced(marks: DataFrame | None, new: DataFrame) -> DataFrame:
    """source_id, mark, total after ``new`` (doc_id, source_id) has been taken in; marks never go back."""
    seen = new.groupBy("source_id").agg(F.max("doc_id").alias("mark"), F.count("*").alias("total"))
    both = seen if marks is None else seen.unionByName(marks.select("source_id", "mark", "total"))
    return both.groupBy("source_id").agg(F.max("mark").alias("mark"), F.sum("total").alias("total"))


def admitted(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """source_id, verdict of candidates (source_id, n_docs): 'bad id' unless lower-case letters, digits and underscores, 'exists' if ``known`` (source_id) has it, 'empty' without documents, else 'added'."""
    there = known.select("source_id", F.lit(True).alias("__known")).distinct()
    rows = candidates.groupBy("source_id").agg(F.sum("n_docs").alias("n_docs")).join(there, "source_id", "left")
    fine = F.coalesce(F.col("source_id").rlike("^[a-z0-9_]+$"), F.lit(False))
    verdict = F.when(~fine, "bad id").when(F.col("__known"), "exists").when(F.coalesce("n_docs", F.lit(0)) == 0, "empty").otherwise("added")
    return rows.select("source_id", verdict.alias("verdict"))
