"""Ranking of a second corpus of community posts: post_id, title, body, votes, replies, age_days, group."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, n_of
from ..sources.shared import written

#: Title words that count for or against a post.
CLICKBAIT = ["wow", "insane", "crazy", "shocking", "!!!", "must watch"]
#: Words of no weight in a title.
STOPWORDS = ["a", "an", "and", "are", "best", "for", "from", "how", "i", "in", "is", "it", "my", "of", "on", "or", "the", "to", "vs", "what", "with", "why", "workflow", "guide", "setup", "issue", "problem", "help", "using"]
TECHNICAL = ["guide", "tutorial", "how to", "setup", "install", "configure", "comparison", "benchmark", "performance"]


def expanded(question: Column, acronyms: dict[str, str]) -> Column:
    """Acronyms as alternatives with their long forms, unless the question has boolean words already."""
    long = F.create_map(*(F.lit(x) for kv in acronyms.items() for x in kv))
    known = lambda w: F.lower(w).isin(list(acronyms))
    one = lambda w: F.when(known(w), F.concat(F.lit("("), w, F.lit(' OR "'), F.element_at(long, F.lower(w)), F.lit('")'))).otherwise(w)
    words = F.filter(F.split(question, r"\s+"), lambda w: w != "")
    return F.when(question.rlike(r"\b(AND|OR|NOT)\b"), question).otherwise(F.array_join(F.transform(words, one), " "))


def expanded_variants(question: Column, variants: dict[str, list[str]]) -> Column:
    """The quoted variants of each keyword that a question has, in front of what is left of it; its negative terms (-word) stay at the end, and no keyword is looked for that is one of them.

    Keywords of three letters and less must be words, longer ones any part; the first place of each goes from the question. A question without a keyword stays as it is.
    """
    negative = F.regexp_extract_all(question, F.lit(r"(?U)-\w+"), F.lit(0))
    rest = F.aggregate(negative, question, lambda q, n: F.replace(q, n, F.lit("")))
    low, start = F.lower(question), F.lower(rest)
    known = F.array(
        *(
            F.struct(
                F.lit(f"-{k}").alias("not"), F.lit(k).alias("word"), F.lit(len(k) <= 3).alias("short"), F.lit(rf"(?iUs)^(.*?){chr(92) + 'b' if len(k) <= 3 else ''}{re.escape(k)}{chr(92) + 'b' if len(k) <= 3 else ''}").alias("first"),
                F.lit("(" + " OR ".join(f'"{v}"' for v in vs) + ")").alias("group"),
            )
            for k, vs in variants.items()
        )
    )

    def step(acc: Column, k: Column) -> Column:
        hit = ~F.contains(low, k["not"]) & F.when(k["short"], F.regexp_like(acc["rest"], k["first"])).otherwise(F.contains(start, k["word"]))
        return F.struct(F.when(hit, F.regexp_replace(acc["rest"], k["first"], F.lit("$1"))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.concat(acc["groups"], F.array(k["group"]))).otherwise(acc["groups"]).alias("groups"))

    done = F.aggregate(known, F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("groups")), step)
    out = lambda d: F.trim(F.concat(F.array_join(d["groups"], " "), F.lit(" "), F.trim(d["rest"]), F.when(F.size(negative) > 0, F.concat(F.lit(" "), F.array_join(negative, " "))).otherwise("")))
    return F.element_at(F.transform(F.array(done), lambda d: F.when(F.size(d["groups"]) > 0, out(d)).otherwise(question)), 1)


def terms(text: Column, stopwords: list[str], least: int = 3) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.array_except(F.filter(F.array_distinct(found), lambda t: F.char_length(t) >= least), F.array(*map(F.lit, stopwords)))


def merged(hits: DataFrame) -> DataFrame:
    """One row per post of several strategies' hits (post_id, strategy, pos, votes, replies, body): the most votes and replies, the longest body, all strategies, and the first."""
    return hits.groupBy("post_id").agg(
        F.max("votes").alias("votes"), F.max("replies").alias("replies"), F.max(F.struct(F.char_length("body"), "body")).getField("body").alias("body"),
        F.array_join(F.sort_array(F.collect_set("strategy")), ",").alias("strategies"), F.min(F.struct("pos", "strategy")).getField("strategy").alias("first_strategy"),
    )


def fuzzy_unique(posts: DataFrame, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """``posts`` (post_id, pos, url, title, any others) without those that share a key with a better placed one that stays.

    Keys are the URL (without query and end slashes), the title's letters a to z and digits, and its first eight words
    of two characters and more that are no stopwords (if it has any). That is what a scan in order of ``pos`` keeps. Here it goes in rounds: posts that
    are first of all their keys stay, those that share a key with one of them go, and the rest is looked at again.
    """
    url = F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?]*", 0), "/+$", "")
    low = F.lower(F.coalesce("title", F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"[a-z0-9_+#.-]{2,}"), 0), lambda w: ~w.isin(stopwords) if stopwords else F.lit(True))
    head = F.array_join(F.slice(words, 1, 8), " ")
    keys = F.array_compact(F.array(F.concat(F.lit("u "), url), F.concat(F.lit("t "), F.regexp_replace(low, "[^a-z0-9]", "")), F.when(head != "", F.concat(F.lit("s "), head))))
    left = written(posts.select("post_id", "pos", F.explode(keys).alias("key")), "keys")
    kept = None
    while not left.isEmpty():
        place = F.struct("pos", "post_id")
        firsts = left.groupBy("key").agg(F.min(place).alias("first"))
        now = written(left.join(firsts, "key").groupBy("post_id").agg(F.bool_and(place == F.col("first")).alias("stays")).filter("stays").select("post_id"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        taken = left.join(now, "post_id", "left_semi").select("key").distinct()
        gone = left.join(taken, "key", "left_semi").select("post_id").distinct()
        left = written(left.join(gone, "post_id", "left_anti"), "keys")
    return posts.limit(0) if kept is None else posts.join(kept, "post_id", "left_semi")


def simple_score(title: Column, votes: Column, replies: Column, age_days: Column, priority: Column, urgent: bool = False) -> Column:
    """Group priority, freshness (steeper for ``urgent``), votes over the root of age, replies, and words of the title."""
    year = 1 - age_days / 365
    fresh = F.when(age_days < 90, 20 * (1 - age_days / 90)).when(age_days < 365, 5 * year).otherwise(0.0) if urgent else F.when(age_days < 365, 10 * year).otherwise(0.0)
    engaged = F.least(votes / F.sqrt(F.greatest(age_days, F.lit(1.0))) / 10, F.lit(30.0))
    low = F.lower(title)
    return priority * 10 + fresh + engaged + F.least(replies / 5, F.lit(10.0)) - n_of(low, CLICKBAIT) * 3 + n_of(low, TECHNICAL) * 2


def precise_score(title: Column, body: Column, votes: Column, replies: Column, words: list[str], anchors: list[str], keywords: list[str], solutions: list[str], promotional: list[str]) -> Column:
    """Words in title and body, keywords, signs of an answer and of quality, less penalties; from 0 to 1.4."""
    t, b = F.lower(title), F.lower(body)
    both = F.concat_ws(" ", t, b)
    lexical = F.least((n_of(t, words) * 0.65 + n_of(b, words) * 0.30) / max(len(words), 1), F.lit(1.0))
    bonus = F.least(n_of(both, keywords) * 0.08, F.lit(0.24))
    answer = F.when(any_of(both, solutions), 0.10).otherwise(0.0)
    quality = F.least(F.log1p(F.greatest(votes, F.lit(0))) / 8, F.lit(0.18)) + F.least(F.log1p(F.greatest(replies, F.lit(0))) / 10, F.lit(0.10))
    hit = n_of(both, anchors)
    penalty = F.when(hit == 0, 0.28).when((hit == 1) & F.lit(len(anchors) >= 2), 0.10).otherwise(0.0) if anchors else F.lit(0.0)
    penalty = penalty + F.when(any_of(t, promotional), 0.35).otherwise(0.0) + F.when((votes <= 1) & (replies <= 2) & (F.char_length(b) < 120), 0.12).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(lexical * 0.58 + bonus + answer + quality - penalty, F.lit(1.4)))


def hot_score(title: Column, votes: Column, replies: Column, age_hours: Column, keywords: list[str], guide: Column) -> Column:
    """Votes and replies, boosted for guides and keywords; what isn't boosted much decays with age."""
    n = n_of(F.lower(title), keywords)
    boost = F.when(guide, 1.2).otherwise(1.0) * F.when(n > 0, F.least(1 + n * 0.5, F.lit(3.0))).otherwise(1.0)
    score = (votes + replies * 2) * boost
    return F.when(guide | (boost > 1.5), score).otherwise(score / F.pow(age_hours + 2, F.lit(1.5)))


def blended(ai: Column, heuristic: Column, engagement: Column) -> Column:
    return F.coalesce(ai, F.lit(0.5)) * 0.72 + F.least(heuristic / 1.4, F.lit(1.0)) * 0.23 + F.least(F.log1p(engagement) / 8, F.lit(1.0)) * 0.05


def tiered(posts: DataFrame, k: int = 40) -> DataFrame:
    """``posts`` (post_id, score, ai) with tier and place: the best k by score come first, in order of what a model says of them (0.5 where it says nothing); the rest follow by score, without a place."""
    best = posts.orderBy(F.desc("score"), "post_id").limit(k)
    order = Window.orderBy(F.coalesce("ai", F.lit(0.5)).desc(), F.desc("score"), "post_id")
    first = best.withColumn("tier", F.lit(1)).withColumn("place", F.row_number().over(order).cast("long"))
    rest = posts.join(best.select("post_id"), "post_id", "left_anti").withColumn("tier", F.lit(2)).withColumn("place", F.lit(None).cast("long"))
    return first.unionByName(rest)


def picked(question: Column, groups_of: dict[str, list[str]], default: list[str], most: int = 5) -> Column:
    """The first groups, each once, of the keywords that a question contains; the default ones if it has none."""
    strings = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    low = F.lower(question)
    found = F.array_distinct(F.concat(*(F.when(F.contains(low, F.lit(k)), strings(names)).otherwise(strings([])) for k, names in groups_of.items())))
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(strings(default))


def soft_targets(groups: Column, anchors: Column, words: Column, popular: list[str], most: int = 2) -> Column:
    """The groups that tell most: those named by an anchor or a word of the question, not among the popular ones, of short names; in their order where that is equal."""
    score = lambda g: F.array_contains(anchors, F.lower(g)).cast("int") * 5 + F.array_contains(words, F.lower(g)).cast("int") * 3 + (~F.lower(g).isin(popular)).cast("int") + (F.char_length(g) <= 16).cast("int")
    ranked = F.array_sort(F.transform(groups, lambda g, i: F.struct((-score(g)).alias("s"), i.alias("i"), g.alias("g"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["g"])


#: Scores from which posts are shown, and how many of the less sure ones at most.
STRICT, SOFT, FEW = 0.52, 0.44, 4


def gated(scored: DataFrame, by: str, target: int, anchors: bool = False, comparison: bool = False, strict: float = STRICT, soft: float = SOFT, few: int = FEW) -> DataFrame:
    """The best ``target`` of each group that are allowed at ``strict``; where none is, the best of those allowed at ``soft``, ``few`` at most; else none.

    ``scored``: post_id, score, anchor_hits (in all of a post), title_anchor_hits (in title and body), compared (signs of a direct comparison).
    With ``anchors`` a post needs an anchor; in a comparison it needs one in title or body, and one of two anchors and more is strictly allowed only with a direct comparison.
    """

    def allowed(least: float) -> Column:
        ok = F.col("score") >= least
        ok = ok & (F.col("anchor_hits") > 0) if anchors else ok
        if comparison:
            ok = ok & (F.col("title_anchor_hits") > 0)
            ok = ok & ~((F.col("anchor_hits") >= 2) & (F.col("compared") == 0)) if least >= strict else ok
        return F.coalesce(ok, F.lit(False))

    rows = scored.withColumns({"__strict": allowed(strict), "__soft": allowed(soft)}).filter("__strict OR __soft")
    sure = rows.filter("__strict").select(F.col(by).alias("__by"), F.lit(True).alias("__sure")).distinct()  # one row a group
    rows = rows.join(sure, F.col(by).eqNullSafe(F.col("__by")), "left").filter("__strict OR __sure IS NULL")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "post_id"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= target)
    return rows.filter(F.col("__sure").isNotNull() | (F.col("place") <= few)).drop("__strict", "__soft", "__by", "__sure")


def sanitized(text: Column) -> Column:
    """Without combining marks; white space collapsed outside code fences, which stay as they are."""
    parts = F.split(F.regexp_replace(text, r"\p{Mn}+", ""), "```")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, r"[ \t\r\n]+", " ")).otherwise(p)), "```")


#: What an author says where an answer helped.
THANKS = ["worked", "thanks", "thank you", "solved", "fixed", "сработало", "спасибо", "решил"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def tree_lines(comments: DataFrame, thanks: list[str] = THANKS, deepest: int = 3, longest: int = 2000) -> DataFrame:
    """post_id, path, depth, verified, line of the comments (post_id, comment_id, parent_id, author, body, score, post_author) that hang on a post by at most ``deepest`` replies.

    A comment is verified if the post's author thanks in a reply to it. Comments without a body go, with all that hangs
    on them. The path is of places among siblings; each level is one join with the level above, so a cycle is never reached.
    """
    body = F.coalesce("body", F.lit(""))
    for entity, char in ENTITIES.items():
        body = F.replace(body, F.lit(entity), F.lit(char))
    own = comments.withColumn("body", body).withColumn("place", F.row_number().over(Window.partitionBy("post_id", "parent_id").orderBy("comment_id")))
    thanked = own.filter((F.col("author") == F.col("post_author")) & any_of(F.lower("body"), thanks)).select(F.col("post_id").alias("p"), F.col("parent_id").alias("c")).distinct()
    own = own.filter("body <> ''").join(thanked, (F.col("post_id") == F.col("p")) & (F.col("comment_id") == F.col("c")), "left").withColumn("verified", F.col("c").isNotNull()).drop("p", "c")
    level = own.filter("parent_id IS NULL").withColumn("path", F.array("place"))
    out = level.withColumn("depth", F.lit(0))
    for depth in range(1, deepest + 1):
        above = level.select(F.col("post_id").alias("p"), F.col("comment_id").alias("c"), F.col("path").alias("up"))
        level = own.join(above, (F.col("post_id") == F.col("p")) & (F.col("parent_id") == F.col("c"))).withColumn("path", F.concat("up", F.array("place"))).drop("p", "c", "up")
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    indent = F.repeat(F.lit("  "), F.col("depth") + 1)
    text = F.when(F.char_length("body") > longest, F.concat(F.substring("body", 1, longest), F.lit("... (truncated)"))).otherwise(F.col("body"))
    tags = F.concat(F.when(F.lower("author") == F.lower("post_author"), "[OP] ").otherwise(""), F.when(F.col("verified"), "[VERIFIED] ").otherwise(""))
    head = F.concat(indent, F.when(F.col("depth") > 0, "└─ ").otherwise(F.concat("place", F.lit(". "))), tags, F.lit("["), "author", F.lit(" | Score: "), "score", F.lit("]: "))
    line = F.concat(head, F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), indent, F.lit("   "))))
    return out.select("post_id", "path", "depth", "verified", line.alias("line"))


def rendered(lines: DataFrame) -> DataFrame:
    """post_id, n, depth, verified (numbers of comments, levels below the first, verified ones), tree (the lines in order of the tree)."""
    tree = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("post_id").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.count_if("verified").alias("verified"), tree.alias("tree"))
