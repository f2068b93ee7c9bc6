"""A stored inverted index that follows its table.

The index is a ``Store`` of three tables, of which every change appends a segment and rewrites none:

* ``postings`` (term, doc_id, source_id, created_at, row, dl, at, seg): a document's places of a term, in order of the terms; ``row`` tells rows of one id from each other;
* ``seen`` (doc_id, digest, n, dl, seg): the documents as they were indexed;
* ``dead`` (doc_id, until): what a document had in segments before ``until`` is no longer true.

A search reads the postings of its terms from all segments and leaves out the dead ones. ``follow`` compares the files of the
table (path, size, time) with those of the last version; where they differ it compares digests of the documents and
indexes only those that are new or other. From ``MOST`` segments on, the segments are merged into one. All rows of an id are in one segment.
Rows without an id are indexed if ``unnamed`` is set, as if they had one id in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_line
from ..sources.shared import written
from ..sources.store import Store, file_version
from .retrieval import Index, eligible

MOST = 8
#: Documents that are handed to a task's Python at once.
TOGETHER = 500
POSTING = "term string, doc_id long, source_id string, created_at timestamp_ntz, row long, dl int, at array<int>, seg int"
ORDER = ("term", "doc_id")
#: Postings that one task puts in order, and ranges at most: with more, Spark would hold what a task sends in memory.
TO_ORDER, MOST_RANGES = 1_000_000, 200


def hashed() -> Column:
    return F.xxhash64("text", "source_id", F.col("created_at").cast("string"))


def named(docs: DataFrame, unnamed: bool) -> DataFrame:
    return eligible(docs) if unnamed else eligible(docs).filter("doc_id IS NOT NULL")


def digested(docs: DataFrame, unnamed: bool = False) -> DataFrame:
    """doc_id, digest, n of eligible documents; an id that is there more than once is one document of all its rows."""
    return named(docs, unnamed).groupBy("doc_id").agg(F.bit_xor(hashed()).alias("digest"), F.count("*").alias("n"))


def places(docs: DataFrame, seg: int, unnamed: bool = False) -> DataFrame:
    """POSTING and digest of eligible ``docs``: tokens are made on the JVM, and grouped by term within each document as arrays. A row without a term stands for each document itself, with its digest."""
    rows = named(docs, unnamed).select(F.col("doc_id").cast("long"), "source_id", "created_at", F.monotonically_increasing_id().alias("row"), hashed().alias("digest"), token_line(F.col("text")).alias("t"))

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        line, n = batch.column(5), batch.num_rows
        t = pc.split_pattern(line, " ")
        found = t.flatten()
        # A document without tokens is one empty string; pyarrow's if_else misreads strings of a slice, so it isn't made null.
        lengths = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64) - pc.equal(line, "").to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(found.filter(pc.not_equal(found, "")))
        doc = np.repeat(np.arange(n), lengths)
        at = np.arange(len(doc)) - (np.cumsum(lengths) - lengths)[doc]
        key = doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        of = doc[order[first]]
        rows = pa.array(np.concatenate((of, np.arange(n))))
        terms = pa.concat_arrays([coded.dictionary.take(coded.indices.take(pa.array(order[first]))), pa.nulls(n, pa.string())])
        bounds = np.concatenate((first, np.full(n + 1, len(key))))
        digest = pa.concat_arrays([pa.nulls(len(first), pa.int64()), batch.column(4)])
        columns = [terms, *(batch.column(i).take(rows) for i in range(4)), pa.array(lengths, pa.int32()).take(rows), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(at[order], pa.int32())), pa.array(np.full(len(rows), seg), pa.int32()), digest]
        return pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "source_id", "created_at", "row", "dl", "at", "seg", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                yield grouped(batch.slice(k, TOGETHER))

    return rows.mapInArrow(run, f"{POSTING}, digest long")


def documents_of(made: DataFrame) -> DataFrame:
    """The rows of ``seen`` for what ``places`` gave."""
    by = made.filter("term IS NULL").groupBy("doc_id", "seg").agg(F.bit_xor("digest").alias("digest"), F.count("*").alias("n"), F.sum("dl").alias("dl"))
    return by.select("doc_id", "digest", "n", "dl", "seg")


def ordered(postings: DataFrame, rows: int) -> DataFrame:
    """Ranges of terms in order, so that a search for a term or prefix reads the row groups that can have it; a term of very many documents is several ranges.

    There are as many ranges as ``rows``, about the number of postings, ask for, whatever the session's number of shuffle partitions: a task's memory doesn't grow with the table.
    """
    cores = postings.sparkSession.sparkContext.defaultParallelism
    n = min(MOST_RANGES, max(1, -(-rows // TO_ORDER), min(cores, rows // (TO_ORDER // 10))))
    return postings.filter("term IS NOT NULL").drop("digest").repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)


def alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, seg, ...) that nothing later has replaced."""
    if dead is None:
        return rows
    last = dead.groupBy(F.col("doc_id").alias("__d")).agg(F.max("until").alias("__until"))
    return rows.join(last, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("seg") < F.col("__until")), "left_anti")


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose doc_id is one of ``ids`` (doc_id); none is an id too."""
    return rows.join(ids.select(F.col("doc_id").alias("__i")), F.col("doc_id").eqNullSafe(F.col("__i")), "left_semi")


class TextIndex:
    """The index of the table of documents that ``store`` follows; with ``unnamed``, of those without an id too."""

    def __init__(self, store: Store, unnamed: bool = False):
        self.store, self.spark, self.unnamed = store, store.spark, unnamed

    def _dead(self, version: int | None = None) -> DataFrame | None:
        return self.store.read("dead", version) if self.store.segments("dead", version) else None

    def seen(self) -> DataFrame:
        return alive(self.store.read("seen"), self._dead())

    def index(self, version: int | None = None) -> Index:
        """What searches read: live postings, and the number and mean length of the documents."""
        info = self.store.manifest(version)["info"]
        sizes = self.spark.range(1).select(F.lit(info["N"]).cast("long").alias("N"), F.lit(info["tokens"] / info["N"] if info["N"] else None).cast("double").alias("avgdl"))
        return Index(alive(self.store.read("postings", version), self._dead(version)), sizes)

    def terms(self) -> DataFrame:
        """term, df (how many ids have it), n (its places). Only postings of ids with several rows are counted by id."""
        again = self.seen().filter("n > 1").select(F.col("doc_id").alias("__again"))
        postings = self.index().postings.join(again, F.col("doc_id") == F.col("__again"), "left")
        df = F.count_if(F.col("doc_id").isNotNull() & F.col("__again").isNull()) + F.count_distinct("__again")
        return postings.groupBy("term").agg(df.alias("df"), F.sum(F.size("at")).cast("long").alias("n"))

    def build(self, docs: DataFrame, source: list | None = None) -> None:
        """All of ``docs`` (doc_id, source_id, created_at, text), in one segment and one exchange of postings."""
        made = written(places(docs, 0, self.unnamed), "places")  # else ranges are found by tokenizing all texts once more
        seen = written(documents_of(made), "seen")
        n, total = seen.agg(F.sum("n"), F.sum("dl")).first()
        self.store.publish(replace={"postings": ordered(made, made.count()), "seen": seen}, drop=("dead",), info={"source": source, "seg": 1, "N": n or 0, "tokens": total or 0})

    def follow(self, docs: DataFrame, source: list | None = None) -> str:
        """Bring the index up to ``docs``; 'as it was', 'built', 'changed' or 'merged'. ``source`` is the table's version (``file_version`` of its files); equal versions are not looked into."""
        if not self.store.has("postings"):
            self.build(docs, source)
            return "built"
        if source is not None and self.store.manifest()["info"]["source"] == source:
            return "as it was"
        old = self.seen().select(F.col("doc_id").alias("k"), F.col("digest").alias("d0"), F.col("n").alias("n0"))
        now = digested(docs, self.unnamed)
        both = now.join(old, F.col("doc_id").eqNullSafe(F.col("k")), "full").filter("digest IS NULL OR d0 IS NULL OR digest <> d0 OR n <> n0")
        diff = written(both.select(F.coalesce("doc_id", "k").alias("doc_id"), F.col("digest").isNotNull().alias("comes"), F.col("d0").isNotNull().alias("goes")), "diff")
        if diff.isEmpty():
            self.store.publish(info={"source": source})
            return "as it was"
        self.change(among(docs, diff.filter("comes")), diff.filter("goes").select("doc_id"), source)
        return self.merge() if len(self.store.segments("postings")) >= MOST else "changed"

    def change(self, come: DataFrame, go: DataFrame, source: list | None = None) -> None:
        """A segment of the documents that ``come``, new or changed; ids that ``go``, those changed among them, are dead in all earlier segments. Nothing else is read or written but what was seen of them."""
        info = self.store.manifest()["info"]
        seg = info["seg"]
        gone = written(among(self.seen(), go.select("doc_id").distinct()), "gone")
        made = written(places(come, seg, self.unnamed), "places")
        seen = written(documents_of(made), "seen")
        sums = lambda df: [x or 0 for x in df.agg(F.sum("n"), F.sum("dl")).first()]
        (n1, t1), (n0, t0) = sums(seen), sums(gone)
        dead = gone.select("doc_id", F.lit(seg).alias("until"))
        self.store.publish(append={"postings": ordered(made, made.count()), "seen": seen, "dead": dead}, info={"source": source, "seg": seg + 1, "N": info["N"] + n1 - n0, "tokens": info["tokens"] + t1 - t0})

    def upsert(self, docs: DataFrame) -> None:
        """Documents that were inserted or updated, whole: as a trigger on the table would say it."""
        self.change(docs, docs.select("doc_id"))

    def delete(self, ids: DataFrame) -> None:
        """Documents (doc_id) that were deleted."""
        none = self.spark.createDataFrame([], "doc_id long, source_id string, created_at timestamp_ntz, text string")
        self.change(none, ids)

    def merge(self) -> str:
        """All live postings in one segment."""
        stored = self.store.read("postings")
        postings = alive(stored, self._dead()).withColumn("seg", F.lit(0))
        self.store.publish(replace={"postings": ordered(postings, stored.count()), "seen": self.seen().withColumn("seg", F.lit(0))}, drop=("dead",), info={"seg": 1})
        return "merged"


def followed(docs: DataFrame, folder: str, unnamed: bool = False) -> TextIndex:
    """The index under ``folder`` of a table of files, brought up to it."""
    found = TextIndex(Store(docs.sparkSession, folder), unnamed)
    found.follow(docs, file_version(docs.sparkSession, docs.inputFiles()))
    return found
