"""Connected components by contraction, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is its smallest id.

    Each round hooks every vertex to its smallest neighbour, shortens the paths, and contracts the links; a star of
    any size is one round. Minima are partial sums, and joins have both sides dealt for them alone, so a vertex with
    many links is split over tasks. Every round's tables are written, so a lost executor costs a task.
    """
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = cut(links.select(least, most).filter("a < b").distinct(), "links")
    found = None
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up")), "up")
        for _ in range(2):
            up = cut(up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.id")).select("x.id", "y.up"), "up")
        if found is None:
            found = up.withColumnRenamed("up", "component")
        else:
            found = cut(found.join(up.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("up", "component").alias("component")), "found")
        moved = left.join(up.select(F.col("id").alias("a"), F.col("up").alias("u")), "a").join(up.select(F.col("id").alias("b"), F.col("up").alias("v")), "b")
        left = cut(moved.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a < b").distinct(), "links")
    return found if found is not None else left.select(F.col("a").alias("id"), F.col("b").alias("component"))
