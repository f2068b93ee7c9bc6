"""Checks of delivered answers against their scenario: eleven of them, weighted, some of them critical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import stripped

#: A key of a source in an answer, and the marks of an answer that is a raw response.
HANDLE = r"(?i)\b([a-z][a-z0-9_]+:[0-9]+)\b"
RAW_MARKS = ('"mode": "expert_digest"', '"experts": [')
#: Terms that the checks count, by check.
PASSPORT = {"source_expand": ("source_keys_sent", "target", "mode", "warnings", "source_expand", "request passport"), "": ("query_sent", "experts_sent", "response_mode", "target", "warnings", "query and selection")}
PROOF = ("scientifically proven", "proven fact", "железно доказано", "строго доказано", "это факт")
CAUTION = (
    "сигнал", "по источникам", "по этим источникам", "мнение", "похоже", "огранич", "слаб", "не видно", "недостаточно", "caveat", "уточн",
    "не буду", "не буду гадать", "нет previous digest", "нет предыдущего digest", "нет контекста", "нужен основной запрос", "сначала",
)
EXPAND = ("source_expand", "source_key", "раскры", "показать источник", "раскрыть источник", "комментар", "углуб", "targeted expansion", "expansion suggestion", "расшир", "handles")
FETCHED = ("я открыл ссыл", "я перешел по ссыл", "я сходил по ссыл", "я склонировал", "я скачал github", "fetched external", "crawled external")
DELIVERY = {
    "source_expand": ("source_keys_sent", "source_expand", "evidence note", "комментар", "огранич"),
    "relay": ("request passport", "scope and warnings", "expert digest delivery", "digest.position", "digest.key_signals", "source_refs", "comments_digest", "omitted_counts", "expansion candidates"),
    "": ("source_refs", "source_key", "source-backed", "source_expand", "warnings"),
}
NEEDED = {"source_expand": 3, "relay": 5, "": 3}

#: What a scenario says; null fields take the defaults below.
SCENARIO = (
    "struct<response_mode:string,expert_group:string,expert_filter:array<string>,expect_passport:boolean,min_source_handles:int,forbidden_terms:array<string>,forbidden_weight:double,forbidden_critical:boolean,"
    "must_cover_any:array<array<string>>,relay_only:boolean,delivery_terms:array<string>,min_delivery_terms:int,min_chars:int,max_chars:int,expect_expansion:boolean,min_score:double>"
)


def fields() -> list[tuple[str, str]]:
    """Names and types of SCENARIO's fields."""
    return [tuple(f.split(":", 1)) for f in SCENARIO.removeprefix("struct<").removesuffix(">").split(",")]


def normalized(text: Column) -> Column:
    return F.lower(F.regexp_replace(stripped(text), r"[ \t\n\x0B\f\r]+", " "))


def hits(low: Column, terms: Column) -> Column:
    """How many of the terms a normalised text contains; empty ones count nothing."""
    return F.size(F.filter(terms, lambda t: (normalized(t) != "") & F.contains(low, normalized(t))))


def fixed(terms: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, terms))


def hits_of(low: Column, terms: tuple[str, ...]) -> Column:
    """``hits`` of terms that are normalised here."""
    found = F.lit(0)
    for t in terms:
        found = found + F.contains(low, F.lit(" ".join(t.split()).lower())).cast("int")
    return found


def checks(answer: Column, scenario: Column, keys: Column, groups: dict[str, str] | None = None) -> Column:
    """``checks_of`` with the answer, normalised or not, as a variable of a function: it is made once, not for each term."""
    once = F.transform(F.array(F.struct(answer.alias("answer"), normalized(answer).alias("low"))), lambda a: checks_of(a["answer"], a["low"], scenario, keys, groups))
    return F.element_at(once, 1)


def checks_of(answer: Column, low: Column, scenario: Column, keys: Column, groups: dict[str, str] | None = None) -> Column:
    """The checks of an answer as an array of (name, weight, score from 0 to 1, critical).

    ``scenario``: SCENARIO. ``keys``: the source keys of the digest that the answer was to deliver, null or empty if there is none; then only
    the shape of keys and the sources that the scenario names are looked at. ``groups``: another name by which a group may be called.
    """
    s = lambda name, default=None: scenario[name] if default is None else F.coalesce(scenario[name], F.lit(default))
    none = F.array().cast("array<string>")
    list_of = lambda name: F.coalesce(scenario[name], none)

    def one(name: str, weight, score: Column, critical=False) -> Column:
        critical = critical if isinstance(critical, Column) else F.lit(critical)
        weight = weight if isinstance(weight, Column) else F.lit(float(weight))
        return F.struct(F.lit(name).alias("name"), weight.alias("weight"), F.round(F.least(F.greatest(score.cast("double"), F.lit(0.0)), F.lit(1.0)), 3).alias("score"), critical.alias("critical"))

    mode = F.when(s("response_mode", "") == "source_expand", "source_expand").when(s("relay_only", False), "relay").otherwise("")
    per = lambda values: F.when(mode == "source_expand", values("source_expand")).when(mode == "relay", values("relay")).otherwise(values(""))

    passport = F.when(s("response_mode", "") == "source_expand", hits_of(low, PASSPORT["source_expand"])).otherwise(hits_of(low, PASSPORT[""]))
    group = scenario["expert_group"]
    other_name = F.lit(None).cast("string")
    for name, called in (groups or {}).items():
        other_name = F.when(group == name, called).otherwise(other_name)
    names = F.concat(F.when(group.isNotNull(), F.array(group, F.replace(group, F.lit("_"), F.lit(" ")), F.coalesce(other_name, F.lit("")))).otherwise(none), list_of("expert_filter"))
    needed = F.when(group.isNotNull(), 1).otherwise(F.greatest(F.size(list_of("expert_filter")), F.lit(1)))

    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(HANDLE), F.lit(1)))
    least = s("min_source_handles", 1)
    own = F.filter(cited, lambda k: F.array_contains(list_of("expert_filter"), F.substring_index(k, ":", 1)))
    matched = F.when(F.size(F.coalesce(keys, none)) > 0, F.size(F.array_intersect(cited, F.coalesce(keys, none)))).when(F.size(own) > 0, F.size(own)).otherwise(F.size(cited))

    proof = hits_of(low, PROOF) > 0
    forbidden = list_of("forbidden_terms")
    found = hits(low, forbidden) > 0
    cover = F.coalesce(scenario["must_cover_any"], F.array().cast("array<array<string>>"))
    covered = F.size(F.filter(cover, lambda terms: F.exists(terms, lambda t: F.contains(low, t))))
    delivery = F.coalesce(F.when(F.size(list_of("delivery_terms")) > 0, scenario["delivery_terms"]), per(lambda m: fixed(DELIVERY[m])))
    wanted = F.coalesce(scenario["min_delivery_terms"], per(lambda m: F.lit(NEEDED[m])))
    size, short, long = F.length(answer), s("min_chars", 700), s("max_chars", 7000)
    fetched = hits_of(low, FETCHED) > 0
    raw = stripped(answer).startswith("{") | (F.contains(answer, F.lit(RAW_MARKS[0])) & F.contains(answer, F.lit(RAW_MARKS[1])))
    return F.array(
        one("not_raw_json", 1.5, F.when(raw, 0.0).otherwise(1.0), True),
        one("request_passport", 1.0, F.when(~s("expect_passport", True), 1.0).otherwise(passport / 4)),
        one("scope_fidelity", 1.0, F.when(F.size(names) == 0, 1.0).otherwise(hits(low, names) / needed)),
        one("source_grounding", 1.5, F.when(least <= 0, 1.0).otherwise(matched / least)),
        one("signal_honesty", 1.25, F.when(proof, 0.0).otherwise(hits_of(low, CAUTION) / 2), proof),
        one("forbidden_terms", F.when(F.size(forbidden) == 0, 0.5).otherwise(s("forbidden_weight", 1.0)), F.when(found, 0.0).otherwise(1.0), found & s("forbidden_critical", False)),
        one("coverage", F.when(F.size(cover) == 0, 1.25).otherwise(1.5), F.when(F.size(cover) == 0, 1.0).otherwise(covered / F.size(cover))),
        one("relay_delivery", 1.0, hits(low, delivery) / F.greatest(wanted, F.lit(1))),
        one("brevity", 0.75, F.when(size > long, long / size).when(size < short, size / short).otherwise(1.0)),
        one("expand_path", 0.75, F.when(~s("expect_expansion", True), 1.0).otherwise(hits_of(low, EXPAND))),
        one("external_boundary", 0.75, F.when(fetched, 0.0).otherwise(1.0), fetched),
    )


def quality(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """case_id, score, passed of checks (case_id, weight, score, critical, and min_score if the scenario has one): the weighted mean; it passes at ``least`` or min_score unless a critical check is below 1."""
    bar = F.coalesce(F.max("min_score"), F.lit(least)) if "min_score" in rows.columns else F.lit(least)
    out = rows.groupBy("case_id").agg(F.round(F.sum(F.col("weight") * F.col("score")) / F.sum("weight"), 3).alias("score"), F.bool_or(F.col("critical") & (F.col("score") < 1)).alias("blocked"), bar.alias("bar"))
    return out.select("case_id", "score", ((F.col("score") >= F.col("bar")) & ~F.col("blocked")).alias("passed"))
