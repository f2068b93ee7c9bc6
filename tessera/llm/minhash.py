"""Near-duplicates by b-bit MinHash.

``sketch`` reads every text once: its set of 5-word shingles, ``MINIMA`` minima, of which
the low ``BITS`` bits are packed as signature, and band keys of ``ROWS`` minima each.
Texts with equal sets are one class from then on. Candidates come from equal band keys;
the signatures' equal parts, corrected for chance collisions, estimate the similarity, and
candidates estimated below ``FLOOR`` (six standard deviations under the limit) go.
What is left is confirmed on the full sets.

Only as many links as components need are looked at: first every class with the likeliest of
the smallest ids of its bands, then, of bands whose members are still in several
components, pairs across components, as full sets that meet in one task. A band's members are compared in blocks of
``BLOCK``, a block with itself and each later one, so no group is in one task.

Defined cases: a null text, or one without words, has no shingles and is linked with
nothing; fewer than five words are one shingle; repeated rows have equal sets; rows with a
null id are linked with nothing; rows of equal id are one vertex; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import MIX, mixed, spans
from .storage import cut

WIDTH = 5
MINIMA, BITS, ROWS = 128, 4, 4
FLOOR = 0.5
SIMILAR = (75, 100)
BLOCK = 512
PER_CENTER = 64
#: Ids that are broadcast, of about 30 bytes each; beyond, a shuffled semi-join.
MAX_BROADCAST = 1_000_000
_rng = np.random.default_rng(11)
FACTORS = _rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
PLACES = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROW_PLACES = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
COUNTS = np.array([sum((x >> (BITS * i)) & 15 == 0 for i in range(2)) for x in range(256)], np.uint8)  # equal 4-bit parts of a byte that holds a difference


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return np.empty(0, np.uint64)
    words = spans(raw, starts, ends)
    k = min(n, width)
    sums = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        sums += words[i : n - k + 1 + i] * PLACES[i]
    return np.unique(mixed(sums + np.uint64(k * int(MIX) % (1 << 64))))


def minima(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (x[i : i + 256, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    low = ((least * np.uint32(0x85EBCA6B)) >> np.uint32(28)).astype(np.uint8)
    return (low[::2] | (low[1::2] << BITS)).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(-1, ROWS).astype(np.uint64)
    return mixed((rows * ROW_PLACES).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64) * MIX).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity of signatures (uint8 arrays, broadcast against each other), corrected for equal bits of different minima."""
    equal = COUNTS[a ^ b].sum(axis=-1, dtype=np.int32) / MINIMA
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n, own (hash of the set), signature, tags (16 bits of each band's key), bands."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                least = minima(s)
                own = f"{len(s)}:{int(s.sum(dtype=np.uint64)):x}:{int((mixed(s) * MIX).sum(dtype=np.uint64)):x}"
                keys = band_keys(least)
                rows.append((len(s), own, signature(least), keys.astype(np.uint16).tobytes(), keys))
            out = pd.DataFrame(rows, columns=["n", "own", "signature", "tags", "bands"])
            yield out.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy())[["doc_id", "n", "own", "signature", "tags", "bands"]].astype({"doc_id": "Int64"})

    return cut(docs.select("doc_id", "text").mapInPandas(of, "doc_id long, n long, own string, signature binary, tags binary, bands array<long>"), "sketches")


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (center, id) whose full sets are similar enough.

    A center's members come in groups of about PER_CENTER; its text goes once to each. Texts that no pair needs are
    left out first.
    """
    texts = picked(docs, pairs.select(F.col("center").alias("doc_id")).unionByName(pairs.select(F.col("id").alias("doc_id"))).distinct())
    many = cut(pairs.groupBy("center").agg(F.ceil(F.count("*") / PER_CENTER).alias("groups")), "centers")
    dealt = cut(pairs.join(many, "center").select("center", "id", F.pmod(F.xxhash64("id"), F.col("groups")).alias("part")), "dealt")
    members = dealt.join(texts, F.col("id") == F.col("doc_id")).select("center", "part", F.lit(1).alias("role"), "id", "text")
    parts = many.select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"))
    centers = parts.join(texts, F.col("center") == F.col("doc_id")).select("center", "part", F.lit(0).alias("role"), F.col("center").alias("id"), "text")

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            out = []
            for center, part, role, doc_id, text in batch.itertuples(index=False):
                if (center, part) != at:
                    at, held = (center, part), []
                own = shingles(text)
                if role == 0:
                    held.append(own)
                elif any(similar(x, own) for x in held):
                    out.append((center, doc_id))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    both = centers.unionByName(members).repartition("center", "part").sortWithinPartitions("center", "part", "role")
    return cut(both.mapInPandas(checked, "a long, b long"), "confirmed")


def best_centers(classes: DataFrame, bands: DataFrame) -> DataFrame:
    """(center, id): for every class, of the smallest ids of its bands the one that most of its bands name, if their signatures reach FLOOR."""
    first = cut(bands.groupBy("band").agg(F.min("doc_id").alias("center"), F.count("*").alias("k")).filter("k > 1").select("band", "center"), "centers")
    named = bands.join(first, "band").filter("doc_id <> center").groupBy("doc_id", "center").count()
    best = named.groupBy("doc_id").agg(F.max(F.struct("count", (-F.col("center")).alias("c"))).alias("best"))
    pairs = cut(best.select("doc_id", (-F.col("best.c")).alias("center")), "stars")
    own = classes.select("doc_id", "signature")
    with_own = pairs.join(own, "doc_id").join(own.select(F.col("doc_id").alias("center"), F.col("signature").alias("other")), "center")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("signature", "other"))
                yield batch.loc[estimate(a, b) >= FLOOR, ["center", "doc_id"]].rename(columns={"doc_id": "id"})

    return cut(with_own.select("doc_id", "center", "signature", "other").mapInPandas(near, "center long, id long"), "best")


MET = "band long, number int, i long, j long, block long, doc_id long, component long, signature binary, tags binary"


class Met:
    """The members of one band in a pair of blocks, and which of them are to be compared: those of different components whose estimate reaches FLOOR, and, of two blocks, one of each.

    Of the bands that two documents share only the first compares them. Tags are the low 16 bits of all band keys; with
    the signatures' bits of a band they tell whether it is shared.
    """

    def __init__(self, rows: list):
        self.ids, self.components, blocks = (np.array([r[k] for r in rows]) for k in range(3))
        self.signatures = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        keys = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), -1).astype(np.uint32)
        self.keys = (keys << np.uint32(16)) | self.signatures.view(np.uint16)
        self.blocks, self.two = blocks, len(set(blocks.tolist())) == 2

    def partners(self, k: int, number: int) -> np.ndarray:
        """Rows after row k to compare it with in band ``number``."""
        later = slice(k + 1, None)
        ok = self.components[later] != self.components[k]
        if self.two:
            ok &= self.blocks[later] != self.blocks[k]
        found = k + 1 + np.flatnonzero(ok)
        found = found[estimate(self.signatures[found], self.signatures[k]) >= FLOOR]
        return found[(self.keys[found] == self.keys[k]).argmax(axis=1) == number]


def groups_of(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[tuple, list]]:
    """(band, number, i, j) and the rows (``columns``) of each group of sorted batches; a group of two blocks only if it has rows of both."""
    at, held = None, []
    whole = lambda at, held: len(held) > 1 and (at[2] == at[3] or len({h[2] for h in held}) == 2)
    for batch in batches:
        for band, number, i, j, *rest in batch[["band", "number", "i", "j", *columns]].itertuples(index=False):
            if (band, number, i, j) != at:
                if whole(at, held):
                    yield at, held
                at, held = (band, number, i, j), []
            held.append(rest)
    if whole(at, held):
        yield at, held


def across(docs: DataFrame, classes: DataFrame, bands: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links between members of one band that are in different components; of what the links of a group of members already connect no more are sent.

    A first pass over signatures finds the members that have someone to be compared with, a second one compares full sets.
    """
    placed = bands.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "number", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = cut(placed, "placed")
    several = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("k")).filter("x <> y")
    several = cut(several.select("band", F.ceil(F.col("k") / BLOCK).alias("blocks")), "several")
    rows = placed.join(several, "band").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    rows = rows.join(classes.select("doc_id", "signature", "tags"), "doc_id")
    # A pair of blocks (i, j), i <= j, gets the rows of both.
    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("band", "number", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "doc_id", "component", "signature", "tags")
    dealt = lambda df: df.repartition("band", "i", "j").sortWithinPartitions("band", "number", "i", "j")
    columns = ["doc_id", "component", "block", "signature", "tags"]

    def worth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at, held in groups_of(batches, columns):
            group, wanted = Met(held), set()
            for k in range(len(held) - 1):
                if len(found := group.partners(k, at[1])):
                    wanted.add(k)
                    wanted.update(found.tolist())
            if wanted:
                out = pd.DataFrame([held[k] for k in sorted(wanted)], columns=columns)
                yield out.assign(band=at[0], number=at[1], i=at[2], j=at[3])[[x.split()[0] for x in MET.split(", ")]]

    some = cut(dealt(met).mapInPandas(worth, MET), "worth")
    texts = picked(docs, some.select("doc_id").distinct())

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at, held in groups_of(batches, [*columns, "text"]):
            group, sets, up, out = Met(held), {}, {}, []

            def root(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            def own(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(held[k][5])
                return sets[k]

            for k in range(len(held) - 1):
                for m in group.partners(k, at[1]).tolist():
                    a, b = root(held[k][1]), root(held[m][1])
                    if a != b and similar(own(k), own(m)):
                        up[max(a, b)] = min(a, b)
                        out.append((held[k][0], held[m][0]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return cut(dealt(some.join(texts, "doc_id")).mapInPandas(linked, "a long, b long"), "links")


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents of ``ids``, by a broadcast of them while they are MAX_BROADCAST at most, else by a shuffled semi-join."""
    ids = cut(ids, "ids")
    few = ids.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    sketches = sketch(docs)
    full = sketches.filter("own IS NOT NULL AND doc_id IS NOT NULL")
    first = cut(full.groupBy("own").agg(F.min("doc_id").alias("rep")), "reps")
    member = cut(full.select("doc_id", "own").join(first, "own").select("doc_id", "rep").distinct(), "members")
    classes = full.join(first.select(F.col("rep").alias("doc_id"), "own"), ["doc_id", "own"], "left_semi").select("doc_id", "signature", "tags", "bands").dropDuplicates(["doc_id", "signature"])
    classes = cut(classes, "classes")
    bands = cut(classes.select("doc_id", F.posexplode("bands").alias("number", "band")), "bands")
    stars = best_centers(classes, bands)
    links = confirm(docs, stars)
    rest = across(docs, classes, bands, components(links))
    same = member.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    known = components(links.unionByName(rest).unionByName(same))
    joined = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of the smallest id; its own columns."""
    gone = cut(near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
