"""Incremental ingest of sources as a stream of files into a store, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.store import Store

#: How many of a source's last documents are looked at again for comments that came late.
RECENT = 10
MARKS = "source_id string, mark long, documents long, comments long"


class Ingest:
    """Takes batches of documents (doc_id, source_id and others) into ``store``.

    A document is new above its source's mark; of repeated ids in a batch one stays. With the new documents go the comments
    (doc_id, comment_id and others) that ``comments`` has for them, and those that came since for the last ``RECENT`` of
    each source. Documents, comments, marks and the batch's number are one version of the store, so a batch
    that is handed over again (the stream was killed before it noted the batch as done) is known and left out.
    """

    def __init__(self, store: Store, name: str = "ingest", comments: Callable[[], DataFrame] | None = None, recent: int = RECENT):
        self.store, self.name, self.comments, self.recent = store, name, comments, recent

    def marks(self) -> DataFrame:
        return self.store.read("marks") if self.store.has("marks") else self.store.spark.createDataFrame([], MARKS)

    def take(self, batch: DataFrame, number: int) -> bool:
        """Whether the batch was new."""
        manifest = self.store.manifest()
        if number <= manifest["info"].get(self.name, -1):
            return False
        marks = self.marks()
        above = batch.join(marks.select("source_id", "mark"), "source_id", "left").filter("mark IS NULL OR doc_id > mark").select(batch.columns)
        new = written(above.dropDuplicates(["source_id", "doc_id"]), "new")
        append, said = {"documents": new}, None
        if self.comments is not None:
            said = written(self._said(new), "said")
            append["comments"] = said.drop("source_id")
        self.store.publish(append=append, replace={"marks": self._advanced(marks, new, said)}, info={self.name: number}, base=manifest["version"])
        return True

    def _said(self, new: DataFrame) -> DataFrame:
        """Comments that aren't stored yet, of new and of recent documents, with the document's source."""
        ids = new.select("source_id", "doc_id")
        if self.store.has("documents"):
            ids = self.store.read("documents").select("source_id", "doc_id").unionByName(ids)
        last = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("doc_id")))  # its limit is taken below the shuffle
        wanted = ids.withColumn("__r", last).filter(F.col("__r") <= self.recent).select("source_id", "doc_id").unionByName(new.select("source_id", "doc_id")).distinct()
        found = self.comments().dropDuplicates(["doc_id", "comment_id"]).join(wanted, "doc_id")
        return found.join(self.store.read("comments").select("doc_id", "comment_id"), ["doc_id", "comment_id"], "left_anti") if self.store.has("comments") else found

    @staticmethod
    def _advanced(marks: DataFrame, new: DataFrame, said: DataFrame | None) -> DataFrame:
        n = lambda c: F.lit(c).cast("long")
        seen = marks.unionByName(new.groupBy("source_id").agg(F.max("doc_id").alias("mark"), F.count("*").alias("documents")).select("source_id", "mark", "documents", n(0).alias("comments")))
        if said is not None:
            seen = seen.unionByName(said.groupBy("source_id").agg(F.count("*").alias("comments")).select("source_id", n(None).alias("mark"), n(0).alias("documents"), "comments"))
        return seen.groupBy("source_id").agg(F.max("mark").alias("mark"), F.sum("documents").alias("documents"), F.sum("comments").alias("comments"))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """All that is there now; another run with the same checkpoint goes on after it."""
        query = stream.writeStream.foreachBatch(lambda df, number: self.take(df, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
