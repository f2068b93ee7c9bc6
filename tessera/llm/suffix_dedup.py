"""Removal of repeated substrings by longest-previous-factor arrays.

Every string of ``LENGTH`` bytes that also starts elsewhere is found, and the bytes that
such strings cover are removed: everywhere (``keep="none"``), or but for each string's
first occurrence (``keep="first"``), in order of the texts' smallest ids and positions.

A suffix array of everything is no work for one task, so suffixes are dealt by what they
share. Each string of LENGTH bytes has an anchor: the ``GRAM`` bytes in it of smallest
hash. Equal strings have equal anchors at equal places, so a task that has all fragments
around one anchor has all suffixes that can match there. The steps:

1. ``runs``: each text is cut into runs of starts with one anchor; anchors that are found
   at one place only are dropped, in partial sums by their hash.
2. ``fragments``: the text of each run that is left; equal fragments are one from there.
   How many places each has is counted, and its text is sent once a task.
3. ``matched``: per anchor, fragments are laid one after another and their suffixes put
   in order; the LPF array tells which starts have an earlier or a later match. Anchors
   with many fragments are dealt in blocks of ``BLOCK``, each with itself and each other
   one; from ``MANY`` on their strings' hashes are counted, whose work grows with the
   number of fragments alone.
4. Matches go back to the places, and to each text.

Texts are known by two 64-bit hashes of theirs; copies of a text are one until the end.

Defined cases: a null text is empty; texts shorter than LENGTH stay whole unless nothing
of this applies to them; of repeated rows each is a text elsewhere for the others; null
ids come last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import BASE, mixed, powers, prefix_sums
from .storage import cut
from .suffix_array import previous_factors, sliding_minimum

LENGTH, GRAM = 400, 64
BLOCK, MANY = 256, 8192
BUFFER = 1 << 20
PIECE = 1 << 23
#: Keys of texts that are broadcast, of about 50 bytes each; beyond, a shuffled semi-join.
MAX_BROADCAST = 1_000_000
KEY = ("c1", "c2")
LAST = (1 << 63) - 1


def text_key() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(1), text).alias("c2")]


def anchor_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first start, last start) of each run of starts of a text that have one anchor."""
    out = []
    for a in range(0, max(1, len(data) - length + 1), PIECE):
        raw = np.frombuffer(data, np.uint8)[a : a + PIECE + length - 1]
        if len(raw) < length:
            continue
        sums = prefix_sums(raw)
        h = sums[gram - 1 :].copy()
        h[1:] -= sums[:-gram]
        h = mixed(h * powers("base", BASE, len(raw))[: len(h)])
        places = np.arange(len(h), dtype=np.uint64)
        least = sliding_minimum((h >> np.uint64(24) << np.uint64(24)) | places, length - gram + 1)  # of equal hashes the first
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(at)])) - 1
        out.append((h[at[first]].view(np.int64), first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """anchor, c1, c2, first, last: the runs of all texts whose anchor is at more than one place."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for c1, c2, text in batch.itertuples(index=False):
                anchor, first, last = anchor_runs((text or "").encode(), length, gram)
                if len(anchor):
                    parts.append((anchor, np.full(len(anchor), c1), np.full(len(anchor), c2), first, last))
            if parts:
                yield pd.DataFrame(dict(zip(("anchor", "c1", "c2", "first", "last"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    rows = cut(docs.select(*text_key(), "text").mapInPandas(found, "anchor long, c1 long, c2 long, first int, last int"), "runs")
    place = F.xxhash64("c1", "c2", "first")
    twice = cut(rows.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("anchor"), "anchors")
    return cut(rows.join(twice, "anchor", "left_semi").distinct(), "repeated")


def picked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are in ``keys``, by a broadcast of them while they are MAX_BROADCAST at most, else by a shuffled semi-join."""
    few = keys.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return docs.join(F.broadcast(keys) if few else keys, list(keys.columns), "left_semi")


def fragments(docs: DataFrame, classes: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """fragment (hash), anchor, c1, c2, first, rep, starts, bytes: a row per place of a repeated anchor; the bytes are null where the task has sent them already."""
    own = runs(docs, length, gram)
    listed = cut(own.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "anchor")).alias("runs")).join(classes.select(*KEY, "rep"), list(KEY)), "listed")
    # One row of each text: that of its smallest id.
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("rep"), *text_key(), F.coalesce("text", F.lit("")).alias("text"))
    texts = picked(keyed, listed.select("rep", *KEY)).join(listed, ["rep", *KEY])

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[bytes] = set()
        names = ["fragment", "anchor", "c1", "c2", "first", "rep", "starts", "bytes"]
        for batch in batches:
            out, size = [], 0
            for c1, c2, rep, text, found in batch.itertuples(index=False):
                data = text.encode()
                for r in found:
                    part = data[r["first"] : r["last"] + length]
                    key = hashlib.blake2b(part, digest_size=16).digest()
                    if key in sent:
                        part = None
                    else:
                        sent.add(key)
                        size += len(part)
                    out.append((key, r["anchor"], c1, c2, r["first"], rep, r["last"] - r["first"] + 1, part))
                if size > 1 << 24 or len(out) > 100_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
                if len(sent) > 1_000_000:
                    sent.clear()
            yield pd.DataFrame(out, columns=names)

    made = texts.select(*KEY, "rep", "text", "runs").mapInPandas(cut_out, "fragment binary, anchor long, c1 long, c2 long, first int, rep long, starts int, bytes binary")
    return cut(made, "fragments")


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


SPANS = "fragment binary, spans array<struct<start:int,end:int>>"


def matched(rows: DataFrame, keep: str, length: int = LENGTH, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """fragment, spans: the starts of each fragment that match another one (an earlier one, if the first are kept); ``rows``: fragment, anchor, order, count (of the anchor's fragments), bytes."""
    usual = rows.filter(F.col("count") <= many)
    blocks = F.ceil(F.col("count") / block)
    usual = usual.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fragment"), "blocks"))
    met = usual.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("anchor", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "order", "fragment", "bytes")
    met = met.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "order")

    def solved(held: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, list]]:
        data = np.frombuffer(b"".join(b for _, b in held), np.uint8)
        sizes = np.array([len(b) for _, b in held])
        ends = np.cumsum(sizes)
        is_start = np.ones(len(data), bool)
        for k in range(1, length):
            is_start[ends - k] = False
        starts = np.flatnonzero(is_start)
        earlier, later = previous_factors(data, starts, length)
        flags = np.zeros(len(data), bool)
        flags[starts] = earlier >= 0 if keep == "first" else (earlier >= 0) | (later >= 0)
        for (key, _), a, b in zip(held, ends - sizes, ends, strict=True):
            if found := spans_of(flags[a:b]):
                yield key, [{"start": x, "end": y} for x, y in found]

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple[bytes, bytes]]]]:
        at, group = None, []
        for batch in batches:
            for anchor, i, j, key, data in batch[["anchor", "i", "j", "fragment", "bytes"]].itertuples(index=False):
                if (anchor, i, j) != at:
                    if len(group) > 1:
                        yield at[0], group
                    at, group = (anchor, i, j), []
                group.append((key, data))
        if len(group) > 1:
            yield at[0], group

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups are put in order together, up to BUFFER bytes; but not two of one anchor, which may have fragments in common."""
        held, size, last = [], 0, None
        for anchor, group in groups(batches):
            if held and (anchor == last or size > BUFFER // 2):
                yield pd.DataFrame(list(solved(held)), columns=["fragment", "spans"])
                held, size = [], 0
            held += group
            size, last = size + sum(len(b) for _, b in group), anchor
        if held:
            yield pd.DataFrame(list(solved(held)), columns=["fragment", "spans"])

    return met.mapInPandas(solve, SPANS).unionByName(counted(rows.filter(F.col("count") > many), keep, length))


def counted(rows: DataFrame, keep: str, length: int = LENGTH) -> DataFrame:
    """``matched`` for anchors with any number of fragments (fragment, anchor, order, bytes): the strings' hashes are counted, in partial sums, and not compared."""

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, order, data in batch.itertuples(index=False):
                n = len(data) - length + 1
                found = [hashlib.blake2b(data[k : k + length], digest_size=16).digest() for k in range(n)]
                yield pd.DataFrame({"fragment": [key] * n, "order": [order] * n, "start": range(n), "string": found})

    kind = f"fragment binary, order {rows.schema['order'].dataType.simpleString()}, start int, string binary"
    all_of = cut(rows.select("fragment", "order", "bytes").mapInPandas(strings, kind), "strings")
    place = F.struct("order", "start", "fragment")
    again = cut(all_of.groupBy("string").agg(F.min(place).alias("one"), F.max(place).alias("two")).filter("one <> two").select("string", "one"), "again")
    hits = all_of.join(again, "string").filter(F.lit(keep != "first") | (place != F.col("one")))
    return hits.groupBy("fragment").agg(F.collect_list(F.struct("start", (F.col("start") + 1).alias("end"))).alias("spans"))


def repeats(docs: DataFrame, classes: DataFrame, keep: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """c1, c2, spans: [start, end) in bytes of what is to be removed of each text, as an only copy or the first one; they may overlap."""
    rows = fragments(docs, classes, length, gram)
    places = cut(rows.drop("bytes").distinct(), "places")
    order = F.struct("rep", *KEY, "first")
    info = places.groupBy("fragment", "anchor", "starts").agg(F.count("*").alias("places"), F.min(order).alias("order"))
    info = cut(info, "info")
    # What is compared is settled before any bytes are dealt.
    anchors = cut(info.groupBy("anchor").count().filter("count > 1"), "counts")
    todo = cut(info.join(anchors, "anchor").select("fragment", "anchor", "order", "count"), "todo")
    texts = rows.filter("bytes IS NOT NULL").select("fragment", "bytes").join(todo.hint("merge"), "fragment").dropDuplicates(["fragment"])
    spans = cut(matched(texts, keep, length), "matched").groupBy("fragment").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    known = info.join(spans, "fragment", "left").filter("places > 1 OR spans IS NOT NULL").select("fragment", "places", "order", F.col("starts").alias("n"), "spans")
    known = cut(known, "known")
    again = F.col("places") > 1
    if keep == "first":
        again &= order != F.col("order")
    both = places.drop("starts", "anchor").join(known, "fragment").withColumn("spans", F.when(again, F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))).otherwise(F.col("spans")))
    moved = F.transform("spans", lambda s: F.struct((F.col("first") + s["start"]).alias("start"), (F.col("first") + s["end"] - 1 + length).alias("end")))
    return cut(both.filter("spans IS NOT NULL").select(*KEY, moved.alias("spans")).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, keep: str = "none", length: int = LENGTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null without ``texts``)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *text_key(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    rows = cut(rows, "texts")
    classes = cut(rows.groupBy(*KEY).agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("rep"), F.count("*").alias("copies")), "classes")
    spans = repeats(docs, classes, keep, length, gram)
    listed = cut(classes.join(spans.select(*KEY, F.lit(True).alias("cut")), list(KEY), "left"), "listed")
    placed = rows.join(listed, list(KEY))
    gone = (F.col("n_bytes") >= length) & (F.col("copies") > 1)
    if keep == "first":
        gone &= F.coalesce("doc_id", F.lit(LAST)) != F.col("rep")
    placed = placed.select("*", gone.alias("gone"))
    empty = F.sha2(F.lit(b""), 256)
    whole = placed.filter("gone OR cut IS NULL").select(
        "doc_id", "n_bytes", F.when(F.col("gone"), F.col("n_bytes")).otherwise(0).alias("n_removed"), F.col("gone").cast("long").alias("n_spans"),
        F.when(F.col("gone"), empty).otherwise(F.col("sha")).alias("kept_sha256"), *KEY, "gone",
    )
    if texts:
        kept = docs.select(F.col("doc_id").alias("id"), *(c.alias(f"t{i}") for i, c in enumerate(text_key())), text.cast("binary").alias("raw"))
        kept = kept.dropDuplicates(["id", "t0", "t1"])
        whole = whole.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("c1") == F.col("t0")) & (F.col("c2") == F.col("t1")))
    raw = F.when(F.col("gone"), F.lit(b"")).otherwise(F.col("raw")) if texts else F.lit(None).cast("binary")
    whole = whole.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", raw.alias("kept"))
    some = cut(listed.filter("cut").filter(F.lit(True) if keep == "first" else (F.col("copies") == 1)).select(*KEY, "rep"), "some")
    keyed = docs.select("doc_id", *text_key(), text.alias("text"), F.coalesce("doc_id", F.lit(LAST)).alias("rep"))
    to_cut = picked(keyed, some).join(spans, list(KEY)).select("doc_id", "text", "spans")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, t, found in batch.itertuples(index=False):
                data = t.encode()
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, [s["start"] for s in found], 1)
                np.add.at(edge, [s["end"] for s in found], -1)
                covered = np.cumsum(edge)[:-1] > 0
                left = np.frombuffer(data, np.uint8)[~covered].tobytes()
                out.append((doc_id, len(data), int(covered.sum()), len(spans_of(covered)), hashlib.sha256(left).hexdigest(), left if texts else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return whole.unionByName(to_cut.mapInPandas(cut_up, RESULT))
