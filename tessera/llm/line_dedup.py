"""Line dedup by winnowing over line hashes.

A run of lines counts as a passage from ``MIN_WORDS`` words on. Of every line on, the
shortest such run from it and the shortest up to it are windows; a window's fingerprint is
the line of the smallest hash in it (the last, if several). Equal passages have equal
windows, so each passage that repeats has a fingerprint that repeats with it.

1. ``outline``: the windows of a text, in time linear in its lines. A place is a line that
   is some window's minimum; it carries its windows' hashes and, as its reach, the line
   hashes from the first of these windows' starts to the last of their ends.
2. Places whose fingerprint is at one place only in the whole corpus are dropped.
3. Positions are joined: each window of a place with the first place that has an equal one,
   in order of the id and line. That is one row a window, so a line that a third of the
   documents have makes as many rows as it has places, and no pairs among these.
4. ``extended``: from each joined pair of positions the match is extended both ways, line
   hash by line hash, as far as both reaches go. Windows that agree in their hash only are found out here.
5. The lines of these matches are deleted from the later document.

Every line of a repeated passage is in a window that fits in the passage, and each such
window is joined with an earlier place, so no part of a passage is left, whichever places
its parts are joined with.

Defined cases: a null text stays null; texts without a window stay as they are; lines are
compared without the white space around them; of overlapping repeats in one document the
first stays; rows alike in id and text are treated alike, as one; rows of equal id are
told apart by their texts; null ids come last; an empty table gives no rows; columns of any
other name and type are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BACK, BASE, mixed, powers
from .storage import bound_batches, cut

MIN_WORDS = 30
#: Keys of documents with repeated lines that are broadcast, of about 40 bytes each; beyond, a sort-merge join.
MAX_BROADCAST = 1_000_000
KEYS = ("doc_id", "__own")
LAST = (1 << 63) - 1


def run_hashes(digests: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run digests[start:end]; equal runs have equal hashes wherever they are."""
    n = len(digests)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digests * powers("back", BACK, n))))
    return mixed((sums[ends] - sums[starts]) * powers("base", BASE, n)[starts] + (ends - starts).astype(np.uint64))


def window_minima(digests: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last place of the smallest digest in each window; starts and ends never fall."""
    out, waiting, upto, value = np.empty(len(starts), np.int64), deque(), 0, digests.tolist()
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        for j in range(upto, b):
            while waiting and value[waiting[-1]] >= value[j]:
                waiting.pop()
            waiting.append(j)
        upto = max(upto, b)
        while waiting[0] < a:
            waiting.popleft()
        out[k] = waiting[0]
    return out


def outline(text: str | None, least: int = MIN_WORDS) -> tuple[np.ndarray, ...] | None:
    """Line digests, and of each window start, end, fingerprint's line and two hashes, in order; None without a window."""
    lines = [x.strip() for x in (text or "").split("\n")]
    words = np.cumsum([0] + [len(x.split()) for x in lines])
    if words[-1] < least:
        return None
    digests = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in lines), np.uint64)
    n = len(lines)
    to = np.searchsorted(words, words[:-1] + least)
    i = np.searchsorted(words, words[1:] - least, side="right") - 1
    found = np.unique(np.concatenate(((np.arange(n) * (n + 1) + to)[to <= n], (i * (n + 1) + np.arange(1, n + 1))[i >= 0])))
    starts, ends = found // (n + 1), found % (n + 1)
    return digests, starts, ends, window_minima(digests, starts, ends), run_hashes(digests, starts, ends), run_hashes(mixed(digests), starts, ends)


def lists(values: list[np.ndarray], sizes: list[np.ndarray], kind) -> pa.Array:
    """An Arrow list column of the given sizes."""
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(kind, copy=False)))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))


PLACES = "doc_id long, __own long, fingerprint long, line int, begin int, reach array<long>, starts array<int>, ends array<int>, h1 array<long>, h2 array<long>"


def places(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """A row for each line of a text that is the fingerprint of windows, with these windows."""
    names = [x.split()[0] for x in PLACES.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(k, o) for k, o in enumerate(outline(t, least) for t in batch.column(2).to_pylist()) if o]
            if not made:
                continue
            row, fingerprint, line, begin, reach, reaches, counts = [], [], [], [], [], [], []
            for k, (digests, starts, ends, minima, _, _) in made:
                edge = np.concatenate(([0], np.flatnonzero(np.diff(minima)) + 1, [len(minima)]))
                low, high, at = starts[edge[:-1]], ends[edge[1:] - 1], minima[edge[:-1]]
                n = high - low
                row.append(np.full(len(at), k))
                fingerprint.append(digests[at].view(np.int64))
                line.append(at)
                begin.append(low)
                reach.append(digests[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())].view(np.int64))
                reaches.append(n)
                counts.append(np.diff(edge))
            taken = pa.array(np.concatenate(row))
            flat = lambda x, kind: pa.array(np.concatenate(x).astype(kind, copy=False))
            window = lambda i, kind: lists([o[i].view(np.int64) for _, o in made], counts, kind)
            columns = [batch.column(0).take(taken), batch.column(1).take(taken), flat(fingerprint, np.int64), flat(line, np.int32), flat(begin, np.int32), lists(reach, reaches, np.int64)]
            columns += [window(1, np.int32), window(2, np.int32), window(4, np.int64), window(5, np.int64)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "__own", "text")
    return bound_batches(rows).mapInArrow(of, PLACES)


def extended(starts: np.ndarray, ends: np.ndarray, begin: int, reach: np.ndarray, other_begin: int, other: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """The longest matches around windows [start, end) of a text with the lines ``shift`` before of another one (or of itself), within both reaches."""
    low, high = max(begin, other_begin + shift), min(begin + len(reach), other_begin + shift + len(other))
    same = reach[low - begin : high - begin] == other[low - shift - other_begin : high - shift - other_begin]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8))) + low
    if not len(edge):
        return []
    first, last = edge[::2], edge[1::2]
    at = np.searchsorted(first, starts, side="right") - 1
    held = (at >= 0) & (ends <= last[np.maximum(at, 0)])
    return [(int(first[k]), int(last[k])) for k in np.unique(at[held])]


def repeated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, __own, runs: for each document with repeated lines, the runs [start, end) that are somewhere before."""
    every = cut(places(docs, least), "places")
    place = F.xxhash64(*KEYS, "line")
    shared = cut(every.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("fingerprint"), "shared")
    near = cut(every.join(shared, "fingerprint", "left_semi").withColumn("d", F.coalesce("doc_id", F.lit(LAST))).drop("fingerprint", "doc_id"), "near")
    windows = near.select("d", "__own", "line", F.explode(F.arrays_zip("starts", "ends", "h1", "h2")).alias("w")).select("d", "__own", "line", F.col("w.starts").alias("start"), F.col("w.ends").alias("end"), "w.h1", "w.h2")
    at = F.struct("d", "__own", "start", "line")
    first = cut(windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last").select("h1", "h2", "first"), "first")
    later = windows.join(first, ["h1", "h2"]).filter(at != F.col("first"))
    pair = ("d", "__own", "line", F.col("first.d").alias("d1"), F.col("first.__own").alias("own1"), F.col("first.line").alias("line1"), (F.col("start") - F.col("first.start")).alias("shift"))
    pairs = cut(later.groupBy(*pair).agg(F.collect_set(F.struct("start", "end")).alias("windows")), "pairs")
    reach = cut(near.select("d", "__own", "line", "begin", "reach").dropDuplicates(["d", "__own", "line"]), "reach")
    other = reach.select(F.col("d").alias("d1"), F.col("__own").alias("own1"), F.col("line").alias("line1"), F.col("begin").alias("begin1"), F.col("reach").alias("reach1"))
    both = pairs.join(reach, ["d", "__own", "line"]).join(other, ["d1", "own1", "line1"])
    both = both.select("d", "__own", "shift", "begin", "reach", "begin1", "reach1", F.col("windows.start").alias("starts"), F.col("windows.end").alias("ends"))

    def matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, own, shift, begin, reach, begin1, reach1, starts, ends in batch.itertuples(index=False):
                rows += [(d, own, *run) for run in extended(np.asarray(starts), np.asarray(ends), begin, reach, begin1, reach1, shift)]
            yield pd.DataFrame(rows, columns=["d", "__own", "start", "end"])

    runs = both.mapInPandas(matches, "d long, __own long, start int, end int").groupBy("d", "__own").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    return cut(runs.select(F.when(F.col("d") < LAST, F.col("d")).alias("doc_id"), "__own", "runs"), "runs")


def delete_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with the repeated lines deleted, and ``__lines``, ``__removed``, ``__spans``; ``n_chars`` is made anew where there is one."""
    runs = repeated(docs, least)
    own = keyed(docs)
    there = runs.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(KEYS)))
    few = there.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    there = F.broadcast(there) if few else there
    same = F.col("doc_id").eqNullSafe(F.col("__k0")) & (F.col("__own") == F.col("__k1"))
    # Only texts with something to delete are dealt anew; the others stay in the tasks that read them.
    left = own.join(there, same, "left_anti").select(*docs.columns, F.lit(None).cast(runs.schema["runs"].dataType).alias("__runs"))
    named = runs.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(KEYS)), F.col("runs").alias("__runs")).hint("merge")
    some = own.join(there, same, "left_semi").join(named, same).select(*docs.columns, "__runs")
    joined, at, names = left.unionByName(some), docs.columns.index("text"), [*docs.columns, "__lines", "__removed", "__spans"]

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(len(batch.schema) - 1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                if runs is None or text is None:
                    rows.append((text, len(lines), 0, 0))
                    continue
                gone = np.zeros(len(lines) + 1, int)
                for r in runs:
                    gone[r["start"]] += 1
                    gone[r["end"]] -= 1
                out = np.cumsum(gone)[:-1] > 0
                spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                rows.append(("\n".join(x for x, o in zip(lines, out, strict=True) if not o), len(lines), int(out.sum()), spans))
            text, *counts = (list(x) for x in zip(*rows, strict=True)) if rows else ([],) * 4
            columns = [*batch.columns[:at], pa.array(text, pa.string()), *batch.columns[at + 1 : -1], *(pa.array(c, pa.int32()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.select("*", *(F.lit(0).alias(c) for c in ("__lines", "__removed", "__spans"))).schema
    out = joined.mapInArrow(deleted, kind)
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def clean(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated lines deleted, with its own columns."""
    return delete_repeats(docs, least).select(*docs.columns)
