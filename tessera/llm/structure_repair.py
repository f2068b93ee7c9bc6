"""Repair of the turns of conversations at the least cost: ``(s?(ua)+)?`` over role initials.

1. ``damaged``: the faults that the benchmark plants, chosen by crc32 of ``conv_id:turn``.
2. ``faults``: place, first fault and adjacent roles of every row, by windows of its
   conversation over digests; texts are not moved for that.
3. ``pieces``: rows are dealt by (conversation, block of ``BLOCK`` turns). Each task gathers whole
   blocks up to ``BATCH`` rows and runs one recursive DuckDB query over them: a recursion
   advances one turn of all blocks and keeps, for each state of the grammar that a block may be
   entered in and each that it may be left in, the least cost and of equal ones the least audit.
4. ``folded``: a conversation's pieces in order, from the state before its first turn, as a stream.
5. ``digests``: texts are sorted once, behind their conversation's audit, and hashed as they pass.

Edits of a row are Keep (0), Rerole to the role that the grammar wants (2) and Delete (3); empty turns
are Inserted at 2 anywhere. Rows that are blank or repeat an earlier one must go; a row cut off in
mid-sentence costs 1 more if it stays. An edit's state and audit decide what the repaired row is,
and audits of equal cost in one state are never beginnings of one another (an insertion costs),
so the least of both can be kept turn by turn.

A conversation of any length is split for 3; 4 holds 16 bytes of each turn, since the audit is one value by
contract, and 2 and 5 pass a conversation through the sort of one task, which spills.

Defined cases: a null role or text is one space, and so is a null turn in ``conv_id:turn``; rows
without a conv_id are in no conversation; rows of equal turn are in the order of role and of the
text's digest; a conversation without rows after damage has zeros, an empty audit and the hash of
nothing; other columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bound_batches, cut

BLOCK = 512
BATCH = 16_384
#: White space at the end of a text, as the contract counts it.
SPACES = " \\t\\n\\u000B\\u000C\\r"
ENDS = (".", "!", "?")

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The role that comes next, and the state after it.
WANTED, AFTER = ("u", "u", "a", "u"), (2, 2, 3, 2)
ACCEPTED = (0, 3)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1


def inserts(state: int) -> Iterator[tuple[int, str, int]]:
    """State, audit and cost after none, one or two insertions; more never pay."""
    audit, cost = "", 0
    for _ in range(3):
        yield state, audit, cost
        state, audit, cost = AFTER[state], audit + "I", cost + INSERT


def moves() -> list[tuple[int, str | None, bool, str, int, int]]:
    """(from, initial or null for any, whether the row stays, audit, cost, to): an edit of a row and the insertions behind it."""
    out = []
    for state in range(4):
        edits = [(None, False, "D", DELETE, state), (None, True, "R", REROLE, AFTER[state]), (WANTED[state], True, "K", KEEP, AFTER[state])]
        edits += [("s", True, "K", KEEP, 1)] if not state else []
        out += [(state, initial, stays, audit + more, cost + extra, to) for initial, stays, audit, cost, at in edits for to, more, extra in inserts(at)]
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: ``rows`` after the damage that crc32 of ``conv_id:turn`` modulo 20 chooses."""
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key.cast("binary")) % 20
    rows = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def as_given(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of ``rows`` without damage."""
    return rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(0).alias("copy"))


def digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


ORDER = ["turn", "role", "h", "copy"]  # nulls first


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos (from 1), initial, fault (blank, duplicate, truncated or null), illegal (with the row before) of ``rows`` (conv_id, turn, role, text, copy)."""
    bare = F.expr(f"trim(TRAILING '{SPACES}' FROM text)")
    slim = rows.select("conv_id", "turn", "role", "copy", digest(F.col("text")).alias("h"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("truncated"))
    own = Window.partitionBy("conv_id").orderBy(*ORDER)
    slim = slim.select("*", F.row_number().over(own).alias("pos"), F.substring("role", 1, 1).alias("initial"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "h").orderBy("pos")) > 1
    before = F.lag("initial").over(Window.partitionBy("conv_id").orderBy("pos"))
    slim = slim.withColumn("again", again).withColumn("before", before)
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("truncated"), "truncated")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    return slim.select("conv_id", "turn", "pos", "initial", fault.alias("fault"), illegal.alias("illegal"))


def counted(found: DataFrame) -> DataFrame:
    """conv_id, n, gaps, blank, duplicate, truncated, illegal of ``faults``: partial sums, so a long conversation is no burden."""
    turns = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), F.count_if("illegal").alias("illegal"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("n", "blank", "duplicate", "truncated", "illegal")))


#: The recursive query of a batch: ``turns`` (id, place, initial, gone, cut), ``entries`` (id, entry), ``moves``.
ADVANCE = """
WITH RECURSIVE walk(id, entry, place, state, best) AS (
  SELECT e.id, e.entry, 0, s.state, {{'cost': s.cost, 'audit': s.audit}} FROM entries e JOIN starts s USING (entry)
  UNION ALL
  SELECT w.id, w.entry, t.place, m.next, min({{'cost': w.best.cost + m.cost + CASE WHEN t.cut AND m.stays THEN {cut} ELSE 0 END, 'audit': w.best.audit || m.audit}})
  FROM walk w JOIN turns t ON t.id = w.id AND t.place = w.place + 1 JOIN moves m ON m.state = w.state AND (m.initial IS NULL OR m.initial = t.initial) AND NOT (t.gone AND m.stays)
  GROUP BY ALL
), lengths AS (SELECT id, max(place) AS n FROM turns GROUP BY id)
SELECT w.id, w.entry, w.state, w.best.cost::BIGINT AS cost, w.best.audit AS audit FROM walk w JOIN lengths l ON l.id = w.id AND l.n = w.place ORDER BY ALL
""".format(cut=CUT_OFF)


def connection():
    """DuckDB in a task: one thread, no files."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.execute("CREATE TABLE moves (state INT, initial VARCHAR, stays BOOLEAN, audit VARCHAR, cost INT, next INT)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    # A first block (entry -1) may begin with insertions; in later ones they stand behind the turn before.
    con.execute("CREATE TABLE starts (entry INT, state INT, audit VARCHAR, cost INT)")
    con.executemany("INSERT INTO starts VALUES (?, ?, ?, ?)", [(-1, *x) for x in inserts(0)] + [(s, s, "", 0) for s in range(4)])
    return con


def advanced(con, turns: pa.Table) -> pa.Table:
    """The pieces of a batch of whole blocks, (conv_id, block, pos, initial, fault) in order: conv_id, block, entry, state, cost, audit."""
    con.register("given", turns)
    con.execute("CREATE OR REPLACE TEMP TABLE blocks AS SELECT *, row_number() OVER (ORDER BY conv_id, block) AS id FROM (SELECT DISTINCT conv_id, block FROM given)")
    con.execute(
        "CREATE OR REPLACE TEMP TABLE turns AS SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS place, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, coalesce(fault = 'truncated', false) AS cut FROM given JOIN blocks USING (conv_id, block)"
    )
    con.execute("CREATE OR REPLACE TEMP TABLE entries AS SELECT id, unnest(CASE WHEN block = 0 THEN [-1] ELSE [0, 1, 2, 3] END) AS entry FROM blocks")
    out = con.sql(f"SELECT conv_id, block, entry, state, cost, audit FROM ({ADVANCE}) JOIN blocks USING (id)").to_arrow_table()
    con.unregister("given")
    return out


PIECE = "conv_id long, block long, entry int, state int, cost long, audit string"


def pieces(found: DataFrame, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """Of each block of each conversation, the least cost and audit from state to state."""
    rows = found.select(F.col("conv_id").cast("long"), F.floor((F.col("pos") - 1) / block).cast("long").alias("block"), "pos", "initial", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, held, n = connection(), [], 0
        kinds = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])

        def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                yield from advanced(con, table).select(kinds.names).cast(kinds).to_batches()

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n >= batch:
                table = pa.concat_tables(held)
                conv, at = table["conv_id"], table["block"]
                last, k = (conv[-1].as_py(), at[-1].as_py()), table.num_rows
                while k and (conv[k - 1].as_py(), at[k - 1].as_py()) == last:  # a block at most
                    k -= 1
                yield from made(table.slice(0, k))
                held, n = [table.slice(k)], table.num_rows - k
        if held:
            yield from made(pa.concat_tables(held))

    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(run, PIECE)


def folded(made: DataFrame) -> DataFrame:
    """conv_id, cost, audit: the pieces of each conversation one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, after, at, out = None, {}, {}, None, []

        def done() -> None:
            if now is not None:
                last = after or best
                out.append((now, *min(last[s] for s in ACCEPTED if s in last)))

        def flushed() -> pa.RecordBatch:
            ids, costs, audits = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["conv_id", "cost", "audit"])

        for b in batches:
            for conv, block, entry, state, cost, audit in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if conv != now:
                    done()
                    now, best, after, at = conv, {-1: (0, "")}, {}, block
                elif block != at:
                    best, after, at = after, {}, block
                if entry in best:
                    cand = (best[entry][0] + cost, best[entry][1] + audit)
                    if state not in after or cand < after[state]:
                        after[state] = cand
            if len(out) >= 1000:
                yield flushed()
        done()
        if out:
            yield flushed()

    return made.repartition("conv_id").sortWithinPartitions("conv_id", "block", "entry", "state").mapInArrow(run, "conv_id long, cost long, audit string")


class Mended:
    """The repaired rows of one conversation as a digest, row by row along its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.first = audit, 0, 0, hashlib.sha256(), True
        self.inserted()

    def put(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False

    def wanted(self, text: str) -> None:
        self.put({"u": "user", "a": "assistant"}[WANTED[self.state]], text)
        self.state = AFTER[self.state]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.wanted("")

    def row(self, role: str, text: str) -> None:
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.wanted(text)
        elif edit == "K":
            self.put(role, text)
            self.state = 1 if role[:1] == "s" else AFTER[self.state]
        self.inserted()


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, cost, audit, repaired_sha256: ``rows`` (conv_id, turn, role, text, copy) pass behind their conversation's audit and are hashed one by one."""
    none = lambda kind: F.lit(None).cast(kind)
    turn = rows.schema["turn"].dataType
    rows = rows.select(F.col("conv_id").cast("long"), F.lit(1).alias("kind"), "turn", "role", digest(F.col("text")).alias("h"), "copy", "text", none("long").alias("cost"))
    heads = audits.select("conv_id", F.lit(0).alias("kind"), none(turn).alias("turn"), none("string").alias("role"), none("string").alias("h"), F.lit(0).alias("copy"), F.col("audit").alias("text"), "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mended, out = None, None, []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "cost", "audit", "repaired_sha256"])
            out.clear()
            return batch

        for b in batches:
            for conv, kind, role, text, cost in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if kind:
                    mended.row(role, text)
                    continue
                if now is not None:
                    out.append((*now, mended.audit, mended.sha.hexdigest()))
                now, mended = (conv, cost), Mended(text)
            if len(out) >= 1000:
                yield flushed()
        if now is not None:
            out.append((*now, mended.audit, mended.sha.hexdigest()))
        if out:
            yield flushed()

    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return both.select("conv_id", "kind", "role", "text", "cost").mapInArrow(run, "conv_id long, cost long, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, damage: bool = True, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``conversations`` (conv_id, turn, role, text)."""
    conversations = bound_batches(conversations).select("conv_id", "turn", "role", "text")
    rows = damaged(conversations) if damage else as_given(conversations)
    found = cut(faults(rows), "faults")
    mended = digests(rows, folded(pieces(found, block)))
    every = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    sums = ("gaps", "blank", "duplicate", "truncated", "illegal")
    out = every.join(counted(found), "conv_id", "left").join(mended, "conv_id", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*sums, "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
