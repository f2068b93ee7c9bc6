"""The relevance funnel: chunks, scores, top lists, links between documents, citations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: Ids of a bucket where rows are numbered in order of the id.
IDS = 100_000
RELEVANCE = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "CONTEXT": 3}


def relevance_rank(column: str = "relevance") -> Column:
    rank = F.lit(4)
    for name, n in RELEVANCE.items():
        rank = F.when(F.col(column) == name, n).otherwise(rank)
    return rank


def chunks(docs: DataFrame, size: int = 50) -> DataFrame:
    """``docs`` with ``chunk``: fixed numbers of a source's documents, newest first."""
    newest = -F.datediff("created_at", F.lit("2000-01-01"))  # a day is a bucket; the unknown come last
    rows = numbered(docs, "source_id", [F.desc("created_at"), F.col("doc_id")], F.coalesce(newest, F.lit(1 << 30)), "__place")
    return rows.withColumn("chunk", F.floor((F.col("__place") - 1) / size).cast("long")).drop("__place")


#: Seconds that a task waits once before it tries its failed chunks again, so that a service's limit by the minute has passed.
COOLDOWN = 45.0


def map_scores(docs: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], size: int = 50, retries: int = 1, cooldown: float = COOLDOWN, by: list[str] | None = None) -> DataFrame:
    """doc_id, relevance, reason, error of each document by a model that sees chunks: those that the columns ``by`` tell (as ``chunks`` makes them), or else of ``size`` rows of what a task has.

    Chunks that fail are kept until the task has gone through all others; then it waits ``cooldown`` seconds and tries them again, ``retries`` times.
    What still fails gives nulls and an error, and nothing else is lost.
    """

    def chunks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not by:
            for batch in batches:
                yield from (batch.iloc[a : a + size] for a in range(0, len(batch), size))
            return
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            key = held[by].apply(tuple, axis=1)
            last = key.iloc[-1]  # may go on in the next batch
            for _, one in held[key != last].groupby(by, sort=False, dropna=False):
                yield one
            held = held[key == last]
        if held is not None and len(held):
            yield held

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, failed = ["doc_id", "relevance", "reason", "error"], []
        for chunk in chunks_of(batches):
            try:
                yield scorer(chunk).assign(error=None)[names]
            except Exception as e:  # the model's failure is a result
                failed.append((chunk, str(e)[:200]))
        for _ in range(retries):
            if failed:
                time.sleep(cooldown)
            again, failed = failed, []
            for chunk, _said in again:
                try:
                    yield scorer(chunk).assign(error=None)[names]
                except Exception as e:
                    failed.append((chunk, str(e)[:200]))
        for chunk, said in failed:
            yield pd.DataFrame({"doc_id": chunk["doc_id"], "relevance": None, "reason": None, "error": said})

    dealt = docs.repartition(*by).sortWithinPartitions(*by, "doc_id") if by else docs
    return dealt.mapInPandas(scored, "doc_id long, relevance string, reason string, error string")


def threshold_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """The default model, which is deterministic: relevance by the length of the text."""
    n = batch["text"].str.len()
    relevance = pd.Series("LOW", index=batch.index).mask(n >= 600, "MEDIUM").mask(n >= 2400, "HIGH")
    return pd.DataFrame({"doc_id": batch["doc_id"], "relevance": relevance, "reason": "length " + n.astype(str)})


def with_relevance(docs: DataFrame) -> DataFrame:
    """The default model as an expression."""
    n = F.char_length("text")
    return docs.withColumn("relevance", F.when(n >= 2400, "HIGH").when(n >= 600, "MEDIUM").otherwise("LOW"))


def ranked_by_relevance(docs: DataFrame) -> DataFrame:
    return numbered(docs, "source_id", [relevance_rank(), F.col("doc_id")], F.struct(relevance_rank().alias("r"), F.floor(F.col("doc_id") / IDS).alias("i")), "place")


def parsed_scores(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, score, reason for every one of ``docs`` from model answers of blocks ``=== POST n ===``, ``ID:``, ``Score:``, ``Reason:``; unknown ids are left out, missing ones score 0."""
    blocks = answers.select(F.explode(F.split("answer", "=== POST [0-9]+ ===")).alias("b"))
    field = lambda name, value: F.regexp_extract("b", rf"(?m)^{name}:[ \t]*({value})", 1)
    rows = blocks.select(field("ID", "[0-9]+").try_cast("long").alias("doc_id"), field("Score", "[0-9.]+").try_cast("double").alias("score"), field("Reason", ".*").alias("reason"))
    rows = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("score").alias("score"), F.max("reason").alias("reason"))
    return docs.select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("reason", F.lit("")).alias("reason"))


def best_medium(docs: DataFrame, limit: int = 50, least: float = 0.7, k: int = 5) -> DataFrame:
    """Of each source's first ``limit`` MEDIUM documents those that score ``least``, the best k."""
    first = docs.filter("relevance = 'MEDIUM'").withColumn("pos", F.row_number().over(Window.partitionBy("source_id").orderBy("doc_id"))).filter(F.col("pos") <= limit)
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "pos")
    return first.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbours(seeds: DataFrame, links: DataFrame, docs: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Documents one link away from a seed, in either direction, of the seed's source and not seeds themselves: doc_id, source_id, created_at, parents (sorted), parent (if there is one only).

    Two equi-joins are united, not one join with OR.
    """
    own = seeds.select(F.col("doc_id").alias("seed"), F.col("source_id").alias("of"))
    out = own.join(links, F.col("seed") == F.col("src")).select("seed", "of", F.col("dst").alias("doc_id"))
    back = own.join(links, F.col("seed") == F.col("dst")).select("seed", "of", F.col("src").alias("doc_id"))
    both = out.unionByName(back).join(seeds.select("doc_id"), "doc_id", "left_anti").join(docs.select("doc_id", "source_id", "created_at"), "doc_id")
    both = both.filter(F.col("of") == F.col("source_id"))
    both = both.filter(F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz")) if cutoff else both
    grouped = both.groupBy("doc_id", "source_id", "created_at").agg(F.sort_array(F.collect_set("seed")).alias("parents"))
    return grouped.withColumn("parent", F.when(F.size("parents") == 1, F.element_at("parents", 1)))


def limited(docs: DataFrame, k: int = 50) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy(relevance_rank(), F.desc("created_at"), "doc_id")
    return docs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def citations(answers: DataFrame) -> DataFrame:
    """answer_id, pos, doc_id: each [post:n] of the answers, with repeats, in order."""
    found = F.regexp_extract_all("answer", F.lit(r"\[post:([0-9]+)\]"), 1)
    return answers.select("answer_id", F.posexplode(found).alias("pos", "id")).select("answer_id", "pos", F.col("id").cast("long").alias("doc_id"))


def reconciled(main: Column, cited: Column) -> Column:
    """Main sources with those that are cited but not among them, sorted."""
    return F.array_sort(F.array_union(main, cited))


def accuracy(cited: DataFrame, known: DataFrame) -> DataFrame:
    """answer_id, refs, valid, accuracy: the share of citations (with repeats) of known documents; 1 without any."""
    flags = cited.join(known.select("doc_id", F.lit(1).alias("ok")).distinct(), "doc_id", "left")
    return flags.groupBy("answer_id").agg(F.count("*").alias("refs"), F.count("ok").alias("valid")).withColumn("accuracy", F.col("valid") / F.col("refs"))


def same_fact(a: Column, b: Column, least: float = 0.8) -> Column:
    """Whether one text holds the other, or their sets of words are alike to ``least`` (Jaccard)."""
    x, y = (F.array_distinct(F.split(F.lower(c), r"\s+")) for c in (a, b))
    like = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)) | (like >= least)


class Synthesizer(Protocol):
    """Writes a source's answer from its documents: a column from an ordered array of (place, doc_id, excerpt)."""

    def __call__(self, source: Column, documents: Column) -> Column: ...


def listing(source: Column, documents: Column) -> Column:
    """The default synthesizer, which is deterministic: the source, then each document's citation and excerpt."""
    return F.concat(source, F.lit(": "), F.array_join(F.transform(documents, lambda d: F.concat(F.lit("[post:"), d["doc_id"], F.lit("] "), d["excerpt"])), "; "))


def synthesized(best: DataFrame, synthesizer: Synthesizer = listing) -> DataFrame:
    """source_id, answer from ``best`` (source_id, doc_id, place, excerpt): the few documents of each source that a context limit has left."""
    grouped = best.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "excerpt"))).alias("documents"))
    return grouped.select("source_id", synthesizer(F.col("source_id"), F.col("documents")).alias("answer"))


#: What a request can say of the sources that it wants.
SCOPES = ("all", "group", "custom", "none")


def scoped(requests: DataFrame, known: DataFrame, groups: dict[str, list[str]], excluded: list[str] | None = None) -> DataFrame:
    """request_id, source_id, pos, error: the sources of each request (request_id, scope, group, ids, community) in order, each once; of one that can't be served a row with the error.

    ``all`` is every source of ``known`` (source_id) by name, ``group`` those of a known group, ``custom`` the ids given, trimmed, ``none`` no source,
    which only makes sense with ``community``. Sources that are ``excluded`` are shown nowhere.
    """
    names = known.select("source_id").distinct().agg(F.array_sort(F.collect_list("source_id")).alias("known"))  # one row of names of sources
    none = F.array().cast("array<string>")
    ids, c = F.transform(F.coalesce("ids", none), lambda i: F.trim(i)), F.col
    members = none
    for name, own in groups.items():
        members = F.when(c("group") == name, F.array(*map(F.lit, own))).otherwise(members)
    rows = requests.crossJoin(F.broadcast(names)).select("request_id", "scope", "group", "community", "known", ids.alias("ids"))
    error = (
        F.when(~F.coalesce(c("scope").isin(*SCOPES), F.lit(False)), "unknown scope").when(F.array_contains("ids", ""), "empty id")
        .when((c("scope") == "group") & ~F.coalesce(c("group").isin(*groups), F.lit(False)), "unknown group").when((c("scope") == "custom") & (F.size("ids") == 0), "no ids")
        .when((c("scope") == "custom") & (F.size(F.array_except("ids", "known")) > 0), "unknown ids").when((c("scope") == "none") & ~F.coalesce("community", F.lit(False)), "nothing asked for")
    )
    wanted = F.when(c("scope") == "all", c("known")).when(c("scope") == "group", members).when(c("scope") == "custom", c("ids")).otherwise(none)
    out = rows.withColumn("error", error).withColumn("wanted", F.when(c("error").isNull(), F.array_except(F.array_distinct(wanted), F.array(*map(F.lit, excluded or [])).cast("array<string>"))).otherwise(F.array(F.lit(None).cast("string"))))
    out = out.select("request_id", "error", F.posexplode("wanted").alias("i", "source_id"))
    return out.select("request_id", "source_id", F.when(c("error").isNull(), c("i") + 1).cast("long").alias("pos"), "error")


#: Beginnings of names of months that a claim can name.
NAMED = (("сентябр", 9), ("август", 8), ("июл", 7))


def period_holds(claim: Column, first: Column, last: Column) -> Column:
    """Whether a claim in words fits a period: a month that it names is the first or the last; of ``the last n months`` n is right to one. What can't be read holds."""
    low, months = F.lower(claim), (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1
    n = F.nullif(F.regexp_extract(claim, "[0-9]+", 0), F.lit("")).cast("long")
    out = F.when(F.contains(low, F.lit("последн")) & F.contains(low, F.lit("месяц")) & n.isNotNull(), F.abs(months - n) <= 1).otherwise(True)
    for name, month in reversed(NAMED):
        out = F.when(F.contains(low, F.lit(name)), (F.month(first) == month) | (F.month(last) == month)).otherwise(out)
    return F.coalesce(out, F.lit(True))
