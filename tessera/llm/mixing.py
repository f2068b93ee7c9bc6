"""Mixing sources to target weights by capped water-filling.

``water_fill`` finds each source's target: sources share ``total`` by weight, none above
``max_epochs`` times its own size; what a clamped source can't use is shared again by
weight among the others until none is above. ``mix`` then samples: every document is
taken ``floor(target / source size)`` times whole, and the rest of the target is filled by
documents in a seeded order, the last of them in part, so that a source's taken words are
its target rounded.

The seeded order is that of ``md5(seed, id)``. Its running sum is made in buckets of the
hash's first digits: sums by (source, bucket) are added up within a source, and only rows
of one bucket are ordered in one place, so a source of any share of the rows is spread
over all tasks.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of
its own, last in order; a source of size 0 has target 0; an empty table gives no rows;
repeated rows count each; rows alike in id and size are in any order, with equal results
as a multiset; if the caps together are below ``total``, every source stops at its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, weight): ``weights`` in turn over the sources by code point, null last. One row a source comes in."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``.

    Each round is one aggregate of two numbers; it ends when no free source is above its cap,
    at the latest after as many rounds as there are sources.
    """
    capped = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        used, free, n = capped.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - used) / free
    share = F.col("cap") if not free else F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return capped.withColumn("target", share).drop("cap")


#: Sources whose targets are broadcast, and rows of the buckets that a target ends in, of about 60 bytes each; beyond, a shuffled join.
MAX_BROADCAST = 1_000_000


def placed_key(seed: int) -> Column:
    """Where a row is in the seeded order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))


def plan(docs: DataFrame, weights: DataFrame | None, share: float, max_epochs: float, seed: int, digits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``mix`` is made of: (doc_id, source, size, at) of each row; the targets of the sources; and of each source and bucket how many words come before it, how many are in it, and the source's target."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), placed_key(seed).alias("at")), "sizes")
    by_source = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    weights = cycled_weights(by_source.select("source")) if weights is None else weights
    known = by_source.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
    known = cut(known.select("s.source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")), "weights")
    total = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    ahead = Window.partitionBy("source").orderBy("bucket")
    targets = (
        water_fill(known, total, max_epochs)
        .withColumn("goal", F.round("target").cast("long"))
        .withColumn("repeats", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("goal") - F.col("repeats") * F.col("source_size"))
    )
    buckets = sized.groupBy("source", F.substring("at", 1, digits).alias("bucket")).agg(F.sum("size").alias("n"))
    before = buckets.select("source", "bucket", "n", (F.sum("n").over(ahead) - F.col("n")).alias("before"))
    goals = cut(before.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "bucket", "n", "before", "source_size", "target", "repeats", "rest"), "goals")
    return sized, targets, goals


def shares(sized: DataFrame, goals: DataFrame, digits: int) -> DataFrame:
    """Rows of ``sized`` in buckets of ``goals``, with ``repeats`` and ``part``, the words of one more."""
    bucket = F.substring("at", 1, digits)
    inside = Window.partitionBy("source", "bucket")
    placed = sized.withColumn("bucket", bucket).withColumn("upto", F.sum("size").over(inside.orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    both = placed.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.bucket") == F.col("g.bucket")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - (F.col("upto") - F.col("size"))))
    return both.select("doc_id", "d.source", "size", "source_size", "target", "repeats", part.alias("part"))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, digits: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text; other columns are not needed):

    doc_id, source, size, source_size, target, taken (words), repeats (whole times), part (words of one more).
    ``weights``: (source, weight); by default ``cycled_weights``. ``digits``: hex digits of a bucket.
    """
    sized, _, goals = plan(docs, weights, share, max_epochs, seed, digits)
    return shares(sized, goals, digits).select("doc_id", "source", "size", "source_size", "target", (F.col("repeats") * F.col("size") + F.col("part")).alias("taken"), "repeats", "part")


def take(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, digits: int = 3) -> DataFrame:
    """``docs`` as mixed, with its own columns: each document as often as ``mix`` takes it, the one taken in part counting as whole from half on.

    A row's source and its place in the seeded order tell how often it is taken, but in the one bucket of each source
    that its target ends in; only the rows of those buckets are looked up, so texts stay in the tasks that read them.
    """
    sized, targets, goals = plan(docs, weights, share, max_epochs, seed, digits)
    split = goals.filter("before < rest AND before + n > rest")
    ends = targets.alias("t").join(split.select(F.col("source").alias("s"), F.col("bucket").alias("__end")), F.col("t.source").eqNullSafe(F.col("s")), "left")
    # Without such a bucket the target ends between two: all up to the last one below it are taken once more.
    last = goals.filter("before + n <= rest AND n > 0").groupBy(F.col("source").alias("l")).agg(F.max("bucket").alias("__last"))
    ends = ends.join(last, F.col("source").eqNullSafe(F.col("l")), "left").select(F.col("source").alias("__s"), F.col("repeats").alias("__repeats"), "__end", "__last")
    ends = cut(ends, "ends")
    some = sized.withColumn("bucket", F.substring("at", 1, digits)).alias("d").join(split.select(F.col("source").alias("s"), F.col("bucket").alias("b")), F.col("d.source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left_semi")
    more = shares(some.select("doc_id", "source", "size", "at"), split, digits)
    more = more.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__of"), F.col("size").alias("__size")).agg(F.max((2 * F.col("part") >= F.greatest(F.col("size"), F.lit(1))).cast("long")).alias("__more"))
    more = cut(more, "more")
    small = lambda df: F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df
    rows = docs.withColumn("__b", F.substring(placed_key(seed), 1, digits)).withColumn("__n", n_words(F.col("text")))
    rows = rows.join(small(ends), F.col("source").eqNullSafe(F.col("__s"))).join(small(more), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__of")) & (F.col("__n") == F.col("__size")), "left")
    whole = F.coalesce(F.col("__b") <= F.col("__last"), F.lit(False)) & (F.col("__n") > 0)
    once = F.when(F.col("__b").eqNullSafe(F.col("__end")), F.coalesce("__more", F.lit(0))).otherwise(whole.cast("long"))
    times = F.col("__repeats") + once
    return rows.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)
