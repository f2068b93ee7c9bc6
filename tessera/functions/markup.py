"""Formatted messages as Markdown: texts in parts (exports) and texts with entities by offset (live messages). All on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "array<struct<type:string,offset:int,length:int,url:string,language:string>>"


def kind_of(name: Column) -> Column:
    """One name for what exports and live messages call differently: lower case, without ``MessageEntity`` and underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("plain")), "^MessageEntity", "")), "_", "")


def marked(kind: Column, text: Column, url: Column, language: Column) -> Column:
    """``text`` in the marks of its kind; kinds without marks in Markdown (links, mentions, tags, spoilers, unknown ones) leave it."""
    around = lambda a, b=None: F.concat(F.lit(a), text, F.lit(a if b is None else b))
    return (
        F.when(kind.isin("textlink", "texturl"), F.concat(F.lit("["), text, F.lit("]("), F.coalesce(url, F.lit("")), F.lit(")")))
        .when(kind == "bold", around("**")).when(kind == "italic", around("*")).when(kind == "code", around("`"))
        .when(kind == "pre", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .when(kind.isin("strikethrough", "strike"), around("~~")).when(kind == "underline", around("<u>", "</u>"))
        .when(kind == "blockquote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
        .otherwise(text)
    )


def from_offsets(text: Column, entities: Column) -> Column:
    """``text`` with the marks of its ``entities`` (ENTITY; offsets in code points).

    Entities are put in from the last offset to the first, so that those to come still stand where they say; of equal offsets in the
    order given. Each replaces its stretch of what is there by then with its marks around the stretch of the text as it was,
    so of nested ones the outer marks hold. No entities or null: the text.
    """
    placed = F.transform(entities, lambda e, i: F.struct((-e["offset"]).alias("back"), i.alias("i"), e.alias("e")))

    def put(so_far: Column, one: Column) -> Column:
        e = one["e"]
        own = F.substring(text, e["offset"] + 1, e["length"])
        new = marked(kind_of(e["type"]), own, e["url"], e["language"])
        rest = F.substring(so_far, e["offset"] + e["length"] + 1, F.length(so_far))
        return F.concat(F.when(e["offset"] > 0, F.substring(so_far, F.lit(1), e["offset"])).otherwise(""), new, rest)

    return F.coalesce(F.aggregate(F.array_sort(placed), text, put), text)


def from_parts(value: Column) -> Column:
    """The text of a message as it stands in an export, a VARIANT: a string is itself; of an array the strings, and the objects (type, text, href) with their marks, one after another; anything else is its text."""
    got = lambda v, path: F.try_variant_get(v, path, "string")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"

    def part(v: Column) -> Column:
        own = marked(kind_of(got(v, "$.type")), F.coalesce(got(v, "$.text"), F.lit("")), got(v, "$.href"), F.lit(None).cast("string"))
        return F.when(is_text(v), got(v, "$")).when(F.schema_of_variant(v).startswith("OBJECT"), own).otherwise("")

    parts = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), part), "")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), parts).otherwise(got(value, "$"))


def after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``."""
    return F.substring(text, F.instr(text, mark) + len(mark), F.length(text))


def before(text: Column, mark: str) -> Column:
    """What comes before the first ``mark``, all if there is none."""
    return F.substring_index(text, mark, 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", "")


def segment_title(text: Column) -> Column:
    """The title of a video segment's text (TITLE, SUMMARY, a rule, CONTENT): up to the summary, or to the end of its line; ``Untitled Segment`` without one."""
    has = lambda m: F.contains(text, F.lit(m))
    own = after(text, "TITLE: ")
    return F.when(has("TITLE: ") & has("\nSUMMARY: "), stripped(before(own, "\nSUMMARY: "))).when(has("TITLE: "), stripped(before(own, "\n"))).otherwise("Untitled Segment")


def segment_summary(text: Column) -> Column:
    """Its summary: up to the rule that stands on a line of its own, else up to any three dashes; empty without those."""
    has = lambda m: F.contains(text, F.lit(m))
    loose = after(text, "SUMMARY: ")
    whole = has("\nSUMMARY: ") & has("\n---\n")
    return F.when(whole, stripped(before(after(text, "\nSUMMARY: "), "\n---\n"))).when(has("SUMMARY: ") & F.contains(loose, F.lit("---")), stripped(before(loose, "---"))).otherwise("")


def segment_content(text: Column) -> Column:
    """Its content: after CONTENT, else after the last three dashes, else all of the text."""
    has = lambda m: F.contains(text, F.lit(m))
    return (
        F.when(has("\nCONTENT:\n"), stripped(after(text, "\nCONTENT:\n"))).when(has("CONTENT:"), stripped(after(text, "CONTENT:"))).when(has("---"), stripped(F.substring_index(text, "---", -1))).otherwise(text)
    )


def without_bad_escapes(text: Column) -> Column:
    """Backslashes that begin no escape of JSON (n, t, r, quote, slash, backslash) go."""
    return F.regexp_replace(text, r'\\(?![ntr"\\/])', "")
