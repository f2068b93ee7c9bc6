"""Chat formatting: fingerprints of field paths select declarative mappings to canonical turns.

A layout is known by the hash of the nested field paths that it is made of. ``to_turns``
takes a table whose schema is one of ``TABLES``; ``records_to_turns`` takes JSON records of
any of ``RECORDS``, each by its own fingerprint. Both give ``conv_id, turn, role, text``.
``render`` makes one row per conversation from these: the formatted text, and its segments
with the loss mask (an assistant's texts). ``parse_turns`` and ``loss_text`` read back.

Template: ``\n### role\ntext\n</turn>\n`` per turn. In texts, a backslash goes before each
backslash, ``#`` and ``<``, so no text can hold a control string; in roles, before each
backslash, and a line break becomes ``\n``. Both are undone exactly.

Everything is a DataFrame expression on the JVM. Defined cases: a null text or role is
empty; turns of equal number are ordered by role, then text; repeated rows are repeated
turns; rows with a null id are one conversation; an empty table gives no rows; columns
beside those that a layout needs don't matter. Records of no known layout raise an error
if ``strict``, else they give no turns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layouts of tables: their field paths, and the expressions of the canonical columns (one turn a row, or an array of turns).
TABLES = {
    "rows by turn": (("conv_id", "turn", "role", "text"), {"turn": "turn", "role": "role", "text": "text"}),
    "messages": (("conv_id", "messages[].role", "messages[].content"), {"turns": "transform(messages, m -> struct(m.role AS role, m.content AS text))"}),
    "conversations": (("conv_id", "conversations[].from", "conversations[].value"), {"turns": "transform(conversations, m -> struct(CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END AS role, m.value AS text))"}),
    "instruction, input": (("conv_id", "instruction", "input", "output"), {"turns": "array(struct('user' AS role, concat_ws('\n', instruction, nullif(input, '')) AS text), struct('assistant' AS role, output AS text))"}),
    "instruction": (("conv_id", "instruction", "output"), {"turns": "array(struct('user' AS role, instruction AS text), struct('assistant' AS role, output AS text))"}),
    "prompt": (("conv_id", "prompt", "completion"), {"turns": "array(struct('user' AS role, prompt AS text), struct('assistant' AS role, completion AS text))"}),
    "question": (("conv_id", "question", "response"), {"turns": "array(struct('user' AS role, question AS text), struct('assistant' AS role, response AS text))"}),
}
def pairs(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


#: What JSON records are read as; each layout uses some of it.
RECORD = T.StructType(
    [
        T.StructField("messages", pairs("role", "content")),
        T.StructField("conversations", pairs("from", "value")),
        *(T.StructField(n, T.StringType()) for n in ("instruction", "input", "output", "prompt", "completion", "question", "response")),
    ]
)
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all leaves of a type; ``[]`` stands for an array's element."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return field_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


KNOWN = {p for paths, _ in TABLES.values() for p in paths}
BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in TABLES.items()}


def canonical(df: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def to_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table; its layout is found by the fingerprint of those of its field paths that any layout has."""
    found = fingerprint(KNOWN & set(field_paths(df.schema)))
    if found not in BY_FINGERPRINT:
        raise ValueError(f"no layout has the fingerprint {found[:12]} of {sorted(KNOWN & set(field_paths(df.schema)))}")
    exprs = TABLES[BY_FINGERPRINT[found]][1]
    if "turns" not in exprs:
        return canonical(df.select("conv_id", *(F.expr(e).alias(c) for c, e in exprs.items())))
    return canonical(df.select("conv_id", F.posexplode(F.expr(exprs["turns"])).alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text"))


def records_to_turns(df: DataFrame, record: str = "record", strict: bool = True) -> DataFrame:
    """Canonical turns of JSON records (conv_id, ``record``), each read by the mapping that its own fingerprint selects."""
    parsed = df.select("conv_id", F.from_json(record, RECORD).alias("r")).select("conv_id", "r.*")
    there = [F.when(F.col(f.name).isNotNull(), F.array(*map(F.lit, field_paths(f.dataType, f.name)))).otherwise(F.array().cast("array<string>")) for f in RECORD]
    paths = F.array_sort(F.concat(F.array(F.lit("conv_id")), *there))
    turns = F.raise_error(F.lit("a record has no known layout")).cast(TURNS) if strict else F.lit(None).cast(TURNS)
    case, own = None, F.sha2(F.concat_ws("\n", paths), 256)
    for key, name in BY_FINGERPRINT.items():
        if "turns" in TABLES[name][1]:
            hit = F.expr(TABLES[name][1]["turns"]).cast(TURNS)
            case = F.when(F.col("__fp") == key, hit) if case is None else case.when(F.col("__fp") == key, hit)
    picked = parsed.withColumn("__fp", own).select("conv_id", F.posexplode(case.otherwise(turns)).alias("turn", "t"))
    return canonical(picked.select("conv_id", "turn", "t.role", "t.text"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#<]", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


OPEN, CLOSE = "\n### ", "\n</turn>\n"


def render(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, segments (array of text and loss, whose texts joined are ``formatted``)."""
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def pieces(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")), F.lit(False)), piece(escape(t["text"]), t["role"].isin(*loss_roles)), piece(F.lit(CLOSE), F.lit(False)))

    made = ordered.select("conv_id", F.flatten(F.transform("t", pieces)).alias("segments"))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    rows = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(x, F.char_length(role) + len(OPEN) + 2)).alias("text"))

    return F.transform(rows, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
