"""Document fingerprints: a Merkle tree over paragraphs and sections.

A leaf is a line of the text with its line break, an inner node of the first level a
section: a run of lines up to and with one that is blank, or whose digest's first byte is
below ``SECTION`` (so that a section ends where its content says, not after a number of
lines). The root is over the sections. Equal roots mean equal texts; where roots differ,
``differing`` goes down the branches whose digests differ and gives the spans of the edit.

Lines are long here and an edit within one would make all of it new. So a leaf has parts:
it is cut at places that its content picks (about ``1 << PIECE_BITS`` bytes apart; every
line break is one), and the parts' hashes are the tree's lowest nodes. A fingerprint as text is
``root:size:sketch``; the sketch has the ``SKETCH`` smallest of these hashes, so the
likeness of two fingerprints is read from them alone: Dice's coefficient of the two trees'
lowest nodes, exact up to SKETCH of them and estimated from the smallest of both beyond.

``edits`` pairs each document with the next one in descending order of the id. Whole texts
are dealt once, by ranges of the id that hold about ``RANGE_BYTES`` each at most; the first document of a
range is also sent to the range before it. No task has more than its range, of which it holds two documents at a time.

Defined cases: a null text is empty; the fingerprint of an empty text has no pieces, and is
like another empty one's to 1 and any other to 0; rows of equal id are in order of their
texts; null ids come last; an only document is next to itself; an empty table gives no rows;
columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import BACK, BASE, TABLE, mixed, powers
from .storage import bound_batches, cut

SECTION = 16
PIECE_BITS = 5
SKETCH = 512
RANGE_BYTES = 1 << 26
#: Ids that the driver gets to place the ranges' bounds, of 8 bytes each.
MAX_IDS = 2_000_000


def tree(data: bytes) -> tuple[bytes, list[tuple[bytes, int, int, list[tuple[bytes, int, int]]]]]:
    """Root digest and sections: (digest, start, end, leaves), a leaf being (digest, start, end) in bytes."""
    sections, leaves, at = [], [], 0
    digest = lambda parts: hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    for line in re.findall(rb"[^\n]*\n|[^\n]+", data):
        d = hashlib.blake2b(line, digest_size=16).digest()
        leaves.append((d, at, at + len(line)))
        at += len(line)
        if d[0] < SECTION or line.isspace():
            sections.append((digest(x[0] for x in leaves), leaves[0][1], at, leaves))
            leaves = []
    if leaves:
        sections.append((digest(x[0] for x in leaves), leaves[0][1], at, leaves))
    return hashlib.blake2b(b"".join(s[0] for s in sections), digest_size=32, person=b"root").digest(), sections


def differing(a: tuple, b: tuple) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The spans of leaves (in bytes) of either tree that the other has not; branches with equal digests are not gone into."""
    if a[0] == b[0]:
        return [], []

    def only(x: tuple, y: tuple) -> list[tuple[int, int]]:
        theirs = {s[0] for s in y[1]}
        leaves = {leaf[0] for s in y[1] for leaf in s[3]}
        return [leaf[1:] for s in x[1] if s[0] not in theirs for leaf in s[3] if leaf[0] not in leaves]

    return only(a, b), only(b, a)


def pieces(data: bytes) -> np.ndarray:
    """The distinct 32-bit hashes of a text's pieces, sorted."""
    if not data:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    sums = np.cumsum(TABLE[raw] * powers("back", BACK, n))
    # The hash of the 8 bytes up to each place decides whether a piece ends there.
    last = sums.copy()
    last[8:] -= sums[:-8]
    last *= powers("base", BASE, n)
    ends = np.flatnonzero(((mixed(last) >> np.uint64(40)) & np.uint64((1 << PIECE_BITS) - 1) == 0) | (raw == 10))
    if not len(ends) or ends[-1] != n - 1:
        ends = np.append(ends, n - 1)
    starts = np.concatenate(([0], ends[:-1] + 1))
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    whole = (sums[ends] - before) * powers("base", BASE, n)[starts]
    return np.unique((mixed(whole + (ends - starts).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))


def fingerprint(data: bytes, root: bytes | None = None) -> str:
    """``root``: that of the text's tree, if it is made already."""
    found = pieces(data)
    return f"{(root or tree(data)[0]).hex()}:{len(found)}:{found[:SKETCH].astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """0 to 1, from the fingerprints alone."""
    (root_a, n_a, sketch_a), (root_b, n_b, sketch_b) = a.split(":"), b.split(":")
    if root_a == root_b:
        return 1.0
    n, m = int(n_a), int(n_b)
    if not n or not m:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (sketch_a, sketch_b))
    both = np.union1d(x, y)
    if n > len(x) or m > len(y):  # only the hashes up to the SKETCHth of the union are known of both
        both = both[:SKETCH]
    jaccard = np.isin(np.intersect1d(x, y, assume_unique=True), both, assume_unique=True).sum() / len(both)
    return float(min(1.0, 2 * jaccard / (1 + jaccard)))


def bounds_of(rows: DataFrame, ranges: int, most: int = MAX_IDS) -> np.ndarray:
    """Inner bounds of ranges of the id with about as many rows each, from some hundred ids a range, chosen by hash, ``most`` in all."""
    if ranges < 2:
        return np.empty(0)
    ids = rows.select(F.col("doc_id").cast("double").alias("id")).filter("id IS NOT NULL")
    n = ids.count()
    if n > (wanted := min(most, 200 * ranges)):
        ids = ids.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * wanted / n))
    found = np.sort(ids.toArrow()["id"].to_numpy())
    return np.unique(found[(np.arange(1, ranges) * len(found)) // ranges]) if len(found) else found


def dealt_by_range(docs: DataFrame, ranges: int) -> DataFrame:
    """at, extra, doc_id, text: whole documents in descending order of the id, at least ``ranges`` ranges in as many partitions.

    A row with ``extra`` ends its range: it is the first document of the range after (of the first one, for the last).
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(ranges, -(-size // RANGE_BYTES))
    bounds = bounds_of(rows, ranges)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.fillna(-np.inf).to_numpy(float))).astype("int32")

    rows = rows.withColumn("at", place("doc_id"))
    # A row a range.
    firsts = rows.groupBy("at").agg(F.max("doc_id").alias("first_id"))
    order = Window.orderBy("at")
    last = F.max("at").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = cut(firsts.select("at", "first_id", F.coalesce(F.lag("at").over(order), last).alias("before")), "ranges")
    joined = rows.join(F.broadcast(links), "at")
    own = F.struct("at", F.lit(False).alias("extra"))
    more = F.struct(F.col("before").alias("at"), F.lit(True).alias("extra"))
    both = joined.withColumn("s", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(own, more)).otherwise(F.array(own)))).select("s.at", "s.extra", "doc_id", "text")
    return both.repartitionByRange(len(bounds) + 1, "at").sortWithinPartitions("at", "extra", F.col("doc_id").desc_nulls_last(), "text").withColumn("doc_id", F.col("doc_id").cast("string"))  # null beside large ids would make floats of them


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_leaves int"


def edits(docs: DataFrame, ranges: int, share: int = 3) -> DataFrame:
    """Every text's fingerprint and that of its edited text, whose last floor(n_chars / ``share``) code points are replaced by the first as many (or all) of the next document in descending order of the id.

    ``near_edited`` and ``near_next`` are likenesses of fingerprints; ``edited_leaves`` counts the leaves that the edited text has not.
    """

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the document whose next one has not come yet
        names = [x.split()[0] for x in EDITED.split(", ")]
        for batch in batches:
            out = []
            for at, extra, doc_id, text in batch.itertuples(index=False):
                if extra and held is None:
                    continue
                data = text.encode()
                own = tree(data)
                mark = fingerprint(data, own[0])
                if held is not None and held[0] == at:
                    _, its_id, its_text, its, its_mark = held
                    n = len(its_text)
                    edited = (its_text[: n - n // share] + text[: n // share]).encode()
                    made = tree(edited)
                    changed = fingerprint(edited, made[0])
                    gone = len(differing(its, made)[0])
                    out.append((its_id, n, hashlib.sha256(edited).hexdigest(), its_mark, changed, likeness(its_mark, changed), likeness(its_mark, mark), gone))
                held = None if extra else (at, None if pd.isna(doc_id) else doc_id, text, own, mark)
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "object"})

    made = bound_batches(dealt_by_range(docs, ranges)).mapInPandas(paired, EDITED.replace("doc_id long", "doc_id string"))
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
