"""Rule engines over selected evidence: quality labels, links, checks, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, clip, domain, link_kind, squeeze


def source_type(text: Column, chars: Column, n_links: Column, terms: dict[str, list[str]]) -> Column:
    practice, news, analysis = (any_of(text, terms[k]) for k in ("practitioner", "announcement", "analysis"))
    return (
        F.when(practice, "practitioner_experience").when(news & (n_links > 0), "tool_release").when(news, "announcement").when(analysis, "analysis").when((chars > 0) & (chars < 360), "mention").otherwise("unknown")
    )


def comment_signal(author: Column, community: Column, noise_share: Column) -> Column:
    return (
        F.when((author > 0) & (community > 0), "mixed").when(author > 0, "author_support").when((community > 0) & (noise_share >= 0.7), "mostly_noise").when(community > 0, "community_support").otherwise("none")
    )


def is_noise(text: Column, terms: list[str], most: int = 4) -> Column:
    """A comment of few words, or with a term of low signal."""
    flat = F.lower(F.trim(text))
    return (F.size(F.filter(F.split(flat, r"\s+"), lambda w: w != "")) <= most) | any_of(flat, terms)


def depth(kind: Column, relevance: Column, chars: Column, author: Column, community: Column) -> Column:
    return (
        F.when(kind.isin("announcement", "mention"), "shallow")
        .when((kind == "tool_release") & (chars < 700), "shallow")
        .when((kind == "practitioner_experience") & ((relevance == "HIGH") | (author > 0) | (chars >= 260)), "deep_practical")
        .when((kind == "analysis") & (chars >= 700), "deep_practical")
        .when((chars >= 450) | (author + community > 0) | (relevance == "HIGH"), "moderate")
        .when(chars > 0, "shallow")
        .otherwise("unknown")
    )


def confidence(kind: Column, level: Column, relevance: Column, signal: Column) -> Column:
    backed = signal.isin("author_support", "mixed", "community_support")
    return (
        F.when((level == "deep_practical") & (relevance == "HIGH") & backed, "high")
        .when((relevance == "HIGH") & backed & (level != "unknown"), "medium")
        .when((level == "shallow") | kind.isin("announcement", "mention"), "low")
        .when((relevance == "HIGH") | level.isin("deep_practical", "moderate"), "medium")
        .otherwise("low")
    )


def notes(kind: Column, level: Column, signal: Column, n_links: Column) -> Column:
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(level == "shallow", F.lit("short or announcement-like source")),
                F.when(kind.isin("announcement", "tool_release"), F.lit("announcement/release signal, not deep analysis")),
                F.when(signal == "mostly_noise", F.lit("comments mostly noise")).when(signal != "none", F.concat(F.lit("comments: "), signal)),
                F.when(n_links > 0, F.lit("external links are author-supplied and not fetched")),
            )
        ),
        "; ",
    )


WHITE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A link in Markdown with its label and URL (which may hold pairs of parentheses), and a URL by itself.
MARKDOWN = rf"\[([^\]\n]{{1,200}})\]\((https?://(?:[^{WHITE}()]++|\([^{WHITE}()]*\))+)\)"
BARE = rf"https?://[^{WHITE}<>\]\"']+"
AROUND = 110


def spans_of(text: Column, pattern: str, around: Column) -> Column:
    """Where each match begins, from 0: what stands between matches and the matches before it, added up. ``around``: all matches."""
    between = F.transform(F.split(text, pattern), F.length)
    sizes = F.transform(around, F.length)
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + x)
    return F.transform(around, lambda _, i: total(between, i + 1) + total(sizes, i))


def links_of(docs: DataFrame, around: int = AROUND) -> DataFrame:
    """doc_id, pos, url, domain, label, context, link_type: links in Markdown first, then bare URLs that don't begin within the URL of one of those; each cleaned URL once, where it is first.

    The context is what stands up to ``around`` characters to either side, in one line, with dots where the text goes on.
    """
    text = F.col("text")

    def found(pattern: str, named: bool) -> Column:
        """The matches with their places, as variables of functions: matches are looked for once."""
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        label = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if named else F.transform(every, lambda _: F.lit(None).cast("string"))
        url = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if named else every
        return F.arrays_zip(every.alias("whole"), label.alias("label"), url.alias("url"), spans_of(text, pattern, every).alias("at"))

    rows = docs.filter(F.contains(text, F.lit("http"))).select("doc_id", "text", found(MARKDOWN, True).alias("named"), found(BARE, False).alias("bare"))
    inside = lambda x: F.exists("named", lambda m: (x["at"] >= m["at"] + F.length(m["label"]) + 3) & (x["at"] < m["at"] + F.length(m["label"]) + 3 + F.length(m["url"])))
    every = F.concat("named", F.filter("bare", lambda x: ~inside(x)))

    def described(x: Column) -> Column:
        start, end = F.greatest(x["at"] - around, F.lit(0)), F.least(x["at"] + F.length(x["whole"]) + around, F.length(text))
        said = squeeze(F.substring(text, start + 1, end - start))
        context = F.concat(F.when(start > 0, "... ").otherwise(""), said, F.when(end < F.length(text), " ...").otherwise(""))
        return F.struct(cleaned_url(x["url"]).alias("url"), F.nullif(squeeze(x["label"]), F.lit("")).alias("label"), context.alias("context"))

    links = rows.select("doc_id", F.posexplode(F.transform(every, described)).alias("pos", "l")).select("doc_id", "pos", "l.url", "l.label", "l.context")
    first = F.row_number().over(Window.partitionBy("doc_id", "url").orderBy("pos"))
    links = links.filter(F.col("url").rlike("^https?://[^/?#]")).withColumn("__n", first).filter("__n = 1")
    return links.select("doc_id", "pos", "url", domain(F.col("url")).alias("domain"), "label", "context", link_kind(F.col("url")).alias("link_type"))


def cleaned_url(url: Column) -> Column:
    """Without punctuation at the end, and without last parentheses that nothing opens."""
    cut = F.regexp_replace(F.trim(url), r"[.,;:!?\]}*]+$", "")
    n = lambda c: F.length(cut) - F.length(F.replace(cut, F.lit(c), F.lit("")))
    loose = F.least(F.greatest(n(")") - n("("), F.lit(0)), F.length(F.regexp_extract(cut, r"\)*$", 0)))
    return F.substring(cut, F.lit(1), F.length(cut) - loose)


#: Classes of errors of services in the order in which they are tried, with the patterns that tell them.
ERRORS = (
    ("payment_required", r"402\s+payment\s+required|insufficient\s+credits|prepayment\s+credits?\s+are\s+depleted|credits?\s+are\s+depleted|payment.*required|billing.*issue|manage\s+your\s+project\s+and\s+billing|quota.*exceeded|account.*suspended"),
    ("rate_limit", r"429\s+too\s+many\s+requests|rate\s+limit|too\s+many\s+requests|request\s+limit|frequency\s+limit"),
    ("invalid_request", r"400\s+bad\s+request|invalid\s+request|malformed\s+request|invalid\s+parameter|missing\s+parameter"),
    ("insufficient_permissions", r"401\s+unauthorized|403\s+forbidden|invalid\s+api\s+key|insufficient\s+permissions|access\s+denied|authentication\s+failed"),
    ("model_unavailable", r"model.*not.*found|model.*unavailable|invalid.*model|model.*deprecated|capacity.*exceeded"),
    ("network_error", r"connection.*timeout|network.*error|dns.*resolution.*failed|connection.*refused|ssl.*error|certificate.*error"),
    ("server_error", r"500\s+internal\s+server\s+error|502\s+bad\s+gateway|503\s+service\s+unavailable|504\s+gateway\s+timeout|server.*error|service.*unavailable"),
)
STATUSES = (("payment_required", (402,)), ("rate_limit", (429,)), ("invalid_request", (400, 422)), ("insufficient_permissions", (401, 403)), ("server_error", (500, 502, 503, 504)))


def error_class(message: Column, status: Column | None = None) -> Column:
    """The first class with a pattern in the message, else that of the status code, else unknown_error; without a message unknown_error."""
    out = F.lit("unknown_error")
    for name, codes in STATUSES if status is not None else ():
        out = F.when(status.isin(*codes), name).otherwise(out)
    for name, pattern in reversed(ERRORS):
        out = F.when(F.lower(message).rlike(pattern), name).otherwise(out)
    return F.when(F.coalesce(message, F.lit("")) == "", "unknown_error").otherwise(out)


def expanded(keys: DataFrame, docs: DataFrame, comments: DataFrame, chars: int, most: int) -> DataFrame:
    """doc_id, found, content (clipped), cut, comments (the first ids), omitted, links (url and type of each, in order) for each of ``keys`` (doc_id); a key that isn't known is a row too."""
    own = docs.join(keys.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    wanted = own.select(F.col("doc_id").alias("k"), clip(F.col("text"), chars).alias("content"), (F.char_length(squeeze(F.col("text"))) > chars).alias("cut"))
    said = comments.join(keys.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("comment_id")))
    listed = said.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("r") <= most, F.col("comment_id")))).cast("array<string>"), ",").alias("comments"))
    linked = links_of(own).groupBy(F.col("doc_id").alias("l")).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "link_type", "url").alias("said")))).alias("found"))
    rows = keys.join(wanted, F.col("doc_id") == F.col("k"), "left").join(listed.withColumnRenamed("doc_id", "c"), F.col("k") == F.col("c"), "left").join(linked, F.col("k") == F.col("l"), "left")
    links = F.array_join(F.transform(F.coalesce("found", F.array()), lambda x: x["said"]), ", ")
    return rows.select("doc_id", F.col("k").isNotNull().alias("found"), "content", "cut", F.coalesce("comments", F.lit("")).alias("comments"), F.greatest(F.coalesce("n", F.lit(0)) - most, F.lit(0)).alias("omitted"), links.alias("links"))


def digest_counts(index: DataFrame, comments: DataFrame, links: DataFrame, most_sources: int, most_comments: int) -> DataFrame:
    """source_id, sources, shown, omitted, comments, shown_comments, omitted_comments, links.

    ``index`` (source_id, doc_id, place) is shown up to a place of ``most_sources``. Comments (doc_id) and links (src)
    count for what is shown, comments up to ``most_comments`` of a document.
    """
    total = index.groupBy("source_id").agg(F.count("*").alias("sources"))
    shown = index.filter(F.col("place") <= most_sources).select("source_id", "doc_id")
    said = comments.join(shown.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("c"))
    linked = links.select(F.col("src").alias("doc_id")).join(shown.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("l"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    by = shown.join(said, "doc_id", "left").join(linked, "doc_id", "left").groupBy("source_id").agg(
        F.count("*").alias("shown"), n(F.col("c")).alias("comments"), n(F.least(F.coalesce("c", F.lit(0)), F.lit(most_comments))).alias("shown_comments"), n(F.col("l")).alias("links")
    )
    out = total.join(by, "source_id").withColumn("omitted", F.col("sources") - F.col("shown"))
    return out.withColumn("omitted_comments", F.col("comments") - F.col("shown_comments"))


#: Levels of support of a signal.
SUPPORT = ("direct", "indirect", "weak", "unknown")


def signals(raw: Column, refs: Column, most: int) -> Column:
    """The first ``most`` signals (claim, support_level, sources) of an array of raw ones (claim, support_level, supporting_sources) that claim something, with sources that are known; without any, one for each of ``refs`` (source_key, reason)."""
    known = F.transform(refs, lambda r: r["source_key"])
    level = lambda s: F.when(F.trim(s["support_level"]).isin(*SUPPORT), F.trim(s["support_level"])).otherwise("unknown")
    one = lambda s: F.struct(F.trim(s["claim"]).alias("claim"), level(s).alias("support_level"), F.filter(s["supporting_sources"], lambda k: F.array_contains(known, k)).alias("sources"))
    kept = F.slice(F.transform(F.filter(raw, lambda s: F.trim(F.coalesce(s["claim"], F.lit(""))) != ""), one), 1, most)
    own = F.transform(F.slice(refs, 1, most), lambda r: F.struct(F.coalesce(r["reason"], r["source_key"]).alias("claim"), F.lit("direct").alias("support_level"), F.array(r["source_key"]).alias("sources")))
    return F.when(F.size(kept) > 0, kept).otherwise(own)


def artifact_sources(artifacts: DataFrame) -> DataFrame:
    """request_id, source_key, source_id, place: each key of a result, where it is first: among its sources, then of each expert the main ones, those referred to, and those of the index."""
    kind = "array<struct<source_id:string,source_key:string>>"
    keys = lambda found, who: F.coalesce(F.transform(found, lambda s: F.struct(who.alias("source_id"), s["source_key"].alias("source_key"))), F.array().cast(kind))
    of = lambda e: F.concat(keys(e["main_sources"], e["expert_id"]), keys(e["digest"]["source_refs"], e["expert_id"]), keys(e["digest"]["source_index"], e["expert_id"]))
    top = F.coalesce(F.transform("sources", lambda s: F.struct(s["expert_id"].alias("source_id"), s["source_key"].alias("source_key"))), F.array().cast(kind))
    listed = F.concat(top, F.coalesce(F.flatten(F.transform("experts", of)), F.array().cast(kind)))
    rows = artifacts.select("request_id", F.posexplode(listed).alias("pos", "s")).filter("s.source_key <> ''")
    first = rows.groupBy("request_id", F.col("s.source_key").alias("source_key")).agg(F.min(F.struct("pos", "s.source_id")).alias("f"))
    return first.select("request_id", "source_key", "f.source_id", F.col("f.pos").cast("long").alias("place"))


def artifact_manifest(artifacts: DataFrame) -> DataFrame:
    """request_id, experts (ids in their order), expert_count, source_keys_count."""
    ids = F.filter(F.transform("experts", lambda e: e["expert_id"]), lambda i: i != "")
    n = artifact_sources(artifacts).groupBy("request_id").agg(F.count("*").alias("source_keys_count"))
    out = artifacts.select("request_id", F.coalesce(ids, F.array().cast("array<string>")).alias("experts")).join(n, "request_id", "left")
    return out.select("request_id", "experts", F.size("experts").cast("long").alias("expert_count"), F.coalesce("source_keys_count", F.lit(0)).alias("source_keys_count"))
