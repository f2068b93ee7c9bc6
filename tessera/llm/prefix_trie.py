"""The trie of the prefixes of conversations, as succinct level-order tries of shards.

1. ``rebuilt``: the turns of every conversation after its first ones were exchanged for another's, as labels
   (16-byte digests of role and text) and word counts; texts are dealt once, for the order of turns.
2. ``prefixes``: one pass over a conversation's turns in order gives each prefix a key, the digest of
   the key before it and the label. A node is a key; its members are partial sums, so a prefix
   that a third of all conversations share is no burden.
3. ``sharded``: nodes of two members and more are in tiers, by the power of ``WIDE`` that their members
   come to; a shard is what hangs together within a tier, found by doubling pointers to the shard's top.
   Of nodes in one depth of a shard there are at most ``WIDE``, since their members are different ones.
4. ``rolled``: a task builds the tries of its shards in level order (LOUDS: a bit for each child, then
   a 0, and labels in the order of the ones), finds each node's parent by the zeros before its one, and adds
   leaves and saved tokens up in reverse order with ``np.add.at``. Heavy upper levels come last: each tier takes
   the totals of the tops below it, summed by parent.
5. A prefix of one conversation alone has one leaf below it and saves nothing, so such tails need no trie.
6. ``end_digests``: ids of conversations that end at a node are joined to stretches by ranges of
   (node, id), then hashed one stretch after another as they pass.

Defined cases: a null role or text is empty; rows without a conv_id are in no conversation; turns
of equal number are in the order of role, then text; a conversation whose turns all went is a member of the root and ends there; other
columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bound_batches, cut

#: Members from which nodes are in the next tier: of one depth, a shard has so many nodes at most.
WIDE = 4096
#: Turns that are taken from the conversation whose id is the last multiple of FAMILY.
FAMILY, HEAD = 20, 4
ROOT = bytes(16)
STRETCH = 4096


def kept_head(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEAD


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), label, words of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    label = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    return rows.select("conv_id", pos.alias("pos"), label.alias("label"), words.alias("words"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, label, words: the first turns are those of the family's first conversation; pos has gaps where that has fewer. A row of pos 0 stands for the conversation itself."""
    turns = cut(numbered_turns(conversations), "turns")
    every = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEAD)).select(F.col("conv_id").alias("family"), "pos", "label", "words")
    wanted = every.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), kept_head(F.col("conv_id")).alias("h")).filter("h > 0")
    taken = wanted.join(heads, "family").filter("pos <= h").select("conv_id", "pos", "label", "words")
    own = turns.filter(F.col("pos") > kept_head(F.col("conv_id")))
    itself = every.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(taken).unionByName(itself)


def as_given(conversations: DataFrame) -> DataFrame:
    """``rebuilt`` without an exchange."""
    turns = cut(numbered_turns(conversations), "turns")
    itself = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("words"))
    return turns.unionByName(itself)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, label, words, ends of every prefix of every conversation."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    names = ["conv_id", "depth", "key", "parent", "label", "words", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: whether it ends its conversation is told by the next
        for b in batches:
            out = []
            for conv, label, words in zip(b.column("conv_id").to_pylist(), b.column("label").to_pylist(), b.column("words").to_pylist(), strict=True):
                if label is None:
                    row = (conv, 0, ROOT, None, None, 0)
                else:
                    row = (conv, held[1] + 1, hashlib.blake2b(held[2] + label, digest_size=16).digest(), held[2], label, words)
                if held is not None:
                    out.append((*held, label is None))
                held = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*held, True), kinds, strict=True)], names=names)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(run, "conv_id long, depth long, key binary, parent binary, label binary, words long, ends boolean")


def nodes(rows: DataFrame) -> DataFrame:
    """key, parent, label, depth, conv_id (smallest member), n_convs, words of every node of ``prefixes``."""
    one = [F.min(c).alias(c) for c in ("parent", "label", "words")]
    return rows.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *one)


def sharded(shared: DataFrame, wide: int = WIDE) -> DataFrame:
    """``shared`` (key, parent, depth, n_convs, ...) with tier and shard (the key of the shard's top)."""
    tier = F.lit(0)
    bound, largest = wide, shared.agg(F.max("n_convs")).first()[0] or 0
    while bound < largest:
        tier, bound = tier + (F.col("n_convs") > bound).cast("int"), bound * wide
    rows = cut(shared.withColumn("tier", tier), "tiers")
    above = rows.select(F.col("key").alias("parent"), F.col("tier").alias("above"))
    up = rows.select("key", "parent", "tier").join(above, "parent", "left")
    up = cut(up.select("key", F.when(F.col("above") == F.col("tier"), F.col("parent")).otherwise(F.col("key")).alias("top")), "up")
    while True:  # each round doubles the depth that is passed
        nxt = cut(up.alias("x").join(up.alias("y"), F.col("x.top") == F.col("y.key")).select("x.key", F.col("y.top").alias("top"), (F.col("x.top") != F.col("y.top")).alias("moved")), "up")
        up = nxt.select("key", "top")
        if nxt.filter("moved").isEmpty():
            break
    return rows.join(up.withColumnRenamed("top", "shard"), "key")


class Louds:
    """A forest in level order.

    ``bits``: a 1 for each root and a 0, then for each node in level order a 1 for each child and a 0. ``order``: the
    given rows in the order of the ones, siblings by label; ``labels`` are in that order. 2 bits and a label a node.
    """

    def __init__(self, level: np.ndarray, key: np.ndarray, parent: np.ndarray, label: np.ndarray):
        """``level`` is 0 for roots; the parent of every other row is here, a level above it. Keys, parents and labels are of dtype S16."""
        n = len(key)
        by_key = np.argsort(key)
        own = np.where(level > 0, by_key[np.minimum(np.searchsorted(key[by_key], parent), n - 1)], -1)
        place, degree, order, begin = np.full(n, -1, np.int64), np.zeros(n + 1, np.int64), [], 0
        for rows in np.split(np.argsort(level, kind="stable"), np.cumsum(np.bincount(level))[:-1]):
            above = np.where(own[rows] >= 0, place[own[rows]], -1)
            rows = rows[np.lexsort((key[rows], label[rows], above))]
            place[rows] = np.arange(begin, begin := begin + len(rows))
            np.add.at(degree, np.where(own[rows] >= 0, place[own[rows]] + 1, 0), 1)
            order.append(rows)
        self.order = np.concatenate(order)
        self.labels = label[self.order]
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(degree + 1) - 1] = False
        self.bits, self.n = np.packbits(bits), 2 * n + 1

    def ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.bits, count=self.n))

    def parents(self) -> np.ndarray:
        """Of each node its parent's place in level order, -1 for roots: the zeros before its one are the ends of the lists before its own."""
        ones = self.ones()
        return ones - np.arange(len(ones)) - 1

    def children(self, place: int) -> tuple[int, int]:
        """The places of a node's children (of the roots for -1) as a range."""
        up = self.parents()
        return int(np.searchsorted(up, place)), int(np.searchsorted(up, place, side="right"))

    def rolled(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums of ``values`` (in the order of the given rows) over subtrees: whole levels at a time, from the last to the first."""
        up = self.parents()
        bounds, begin, end = [], 0, int(np.searchsorted(up, -1, side="right"))
        while begin < len(up):
            bounds.append((begin, end))
            begin, end = end, int(np.searchsorted(up, end - 1, side="right"))
        out = []
        for v in values:
            total, back = v[self.order].astype(np.int64), np.empty(len(v), np.int64)
            for a, b in reversed(bounds[1:]):
                np.add.at(total, up[a:b], total[a:b])
            back[self.order] = total
            out.append(back)
        return out


def s16(column) -> np.ndarray:
    return np.array([x or ROOT for x in column.to_pylist()], "S16")


SHARD = ["shard", "key", "parent", "label", "depth", "leaves", "saved"]
ROLLED = "key binary, parent binary, is_top boolean, n_leaves long, saved_tokens long"


def totals(rows: DataFrame) -> DataFrame:
    """ROLLED of ``rows`` (SHARD): each task builds the tries of whole shards, of some batches at a time."""

    def made(table: pa.Table) -> pa.RecordBatch:
        shard, key, parent, label = (s16(table[c]) for c in SHARD[:4])
        depth, leaves, saved = (table[c].to_numpy() for c in SHARD[4:])
        top, of = np.unique(shard, return_inverse=True)
        least = np.full(len(top), np.iinfo(np.int64).max)
        np.minimum.at(least, of, depth)
        sums = Louds(depth - least[of], key, parent, label).rolled(leaves, saved)
        arrays = [table["key"].combine_chunks(), table["parent"].combine_chunks(), pa.array(key == shard), *map(pa.array, sums)]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "parent", "is_top", "n_leaves", "saved_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            last = b.column(0)[-1]
            if held[0].column(0)[0] != last and sum(x.num_rows for x in held) >= BUILT:
                table = pa.Table.from_batches(held)
                done = int(np.argmax(s16(table["shard"]) == np.array([last.as_py()], "S16")[0]))  # the last shard may go on
                yield made(table.slice(0, done))
                held = table.slice(done).to_batches()
        if held:
            yield made(pa.Table.from_batches(held))

    return rows.select(*SHARD).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, ROLLED)


#: Rows of whole shards that are built together.
BUILT = 50_000


def rolled(rows: DataFrame) -> DataFrame:
    """key, n_leaves, saved_tokens of ``sharded`` rows with ``leaves`` and ``saved`` of their own: tier by tier, each with the totals of the tops below it."""
    out, tops = [], []
    for tier in range(1 + (rows.agg(F.max("tier")).first()[0] or 0)):
        of = rows.filter(F.col("tier") == tier).select(*SHARD)
        if tops:
            below = tops[0]
            for t in tops[1:]:
                below = below.unionByName(t)
            below = below.groupBy(F.col("parent").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            more = lambda c: F.coalesce(c, F.lit(0))
            of = of.join(below, "key", "left").withColumns({"leaves": F.col("leaves") + more("more_leaves"), "saved": F.col("saved") + more("more_saved")})
        made = cut(totals(of), "totals")
        out.append(made.select("key", "n_leaves", "saved_tokens"))
        tops.append(made.filter("is_top AND parent IS NOT NULL").select("parent", "n_leaves", "saved_tokens"))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ids (ascending, with commas) of ``ends`` (key, conv_id)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def stretch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["key", "first", "ids"])

        for b in batches:
            for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (key != now or len(ids) >= STRETCH):
                    yield stretch()
                    ids = []
                now = key
                ids.append(conv)
        if ids:
            yield stretch()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []

        def flushed() -> pa.RecordBatch:
            keys, found = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            if len(out) >= 1000:
                yield flushed()
        if now is not None:
            out.append((now, sha.hexdigest()))
        if out:
            yield flushed()

    by_range = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    stretches = by_range.mapInArrow(joined, "key binary, first long, ids string")
    return stretches.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, exchange: bool = True, wide: int = WIDE) -> DataFrame:
    """A row for each node of the trie of ``conversations`` (conv_id, turn, role, text): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its key and its parent's."""
    conversations = bound_batches(conversations).select("conv_id", "turn", "role", "text")
    rows = cut(prefixes(rebuilt(conversations) if exchange else as_given(conversations)), "prefixes")
    every = cut(nodes(rows), "nodes")
    kids = cut(every.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("tails")), "kids")
    leaves = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("tails")).cast("long")
    shared = every.filter("n_convs > 1").join(kids, "key", "left").select("key", "parent", "label", "depth", "n_convs", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = rolled(sharded(shared, wide))
    above = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = every.select("key", "parent", "conv_id", "depth", "n_convs").join(above, "parent", "left")
    out = out.join(kids.drop("tails"), "key", "left").join(sums, "key", "left").join(end_digests(rows.filter("ends")), "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "key", "parent",
    )
