"""Coverage of areas by sources: labels, strengths, passports and gaps, all as grouped aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import stripped
from ..functions.text import any_of, squeeze
from .numbering import numbered


#: What a text's whole tokens are made of; a term of such characters alone must be a token, any other a part of the text.
TOKEN = "[a-z0-9_+#.]+"
#: Terms of news.
NEWS = ("news", "announcement", "анонс", "релиз")


def is_token(term: str) -> bool:
    return re.fullmatch(TOKEN, flat(term)) is not None


def flat(term: str) -> str:
    return " ".join(term.lower().split())


def described(text: Column) -> Column:
    """What rules look at: the text in lower case and one line, and its tokens."""
    low = F.lower(squeeze(text))
    return F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)).alias("tokens"))


def has_any(one: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Whether a described text has any of the terms."""
    whole, parts = [flat(t) for t in terms if is_token(t)], [flat(t) for t in terms if not is_token(t)]
    found = F.arrays_overlap(one["tokens"], F.array(*map(F.lit, whole))) if whole else F.lit(False)
    return found | any_of(one["low"], parts)


def has_any_sql(terms: list[str] | tuple[str, ...]) -> str:
    """The same over columns ``low`` and ``tokens``."""
    whole, parts = [flat(t) for t in terms if is_token(t)], [flat(t) for t in terms if not is_token(t)]
    return "(" + " OR ".join([f"list_has_any(tokens, [{', '.join(map(repr, whole))}])"] * bool(whole) + [f"contains(low, '{p}')" for p in parts]) + ")"


#: Columns ``low`` and ``tokens`` of ``text``.
DESCRIBED_SQL = "lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS low, regexp_extract_all(lower(text), '[a-z0-9_+#.]+') AS tokens"


def once(value: Column, f) -> Column:
    """``f`` of a value as a variable of a function, so that it is made once and not for each rule."""
    return F.element_at(F.transform(F.array(value), f), 1)


def area_labels(text: Column, rules: dict[str, list[str]], generic: str | None = None) -> Column:
    """The areas whose terms a text has; ``generic`` goes if there are others."""
    labels = once(described(text), lambda one: F.array_compact(F.array(*(F.when(has_any(one, terms), F.lit(area)) for area, terms in rules.items()))))
    return labels if generic is None else once(labels, lambda found: F.when(F.size(found) > 1, F.array_remove(found, generic)).otherwise(found))


def depth_label(text: Column, rules: dict[str, list[str]], short: int = 220, news: tuple[str, ...] = NEWS) -> Column:
    """The first rule of which a text has a term; else announcement_or_news if it has a term of news; else low_signal if short, else announcement_or_news."""

    def of(one: Column) -> Column:
        out = F.when(~has_any(one, news) & (F.char_length(stripped(text)) < short), "low_signal").otherwise("announcement_or_news")
        for name, terms in reversed(rules.items()):
            out = F.when(has_any(one, terms), name).otherwise(out)
        return out

    return F.when(text.isNull(), "low_signal").otherwise(once(described(text), of))


def strength(count: Column, total: Column) -> Column:
    share = count / F.greatest(total, F.lit(1))
    return (
        F.when((count <= 0) | (total <= 0), "none").when((count >= 40) & (share >= 0.10), "strong").when((count >= 12) & (share >= 0.04), "medium").otherwise("thin")
    )


def area_status(total: Column, sources: Column) -> Column:
    return (
        F.when((total == 0) | (sources == 0), "gap").when((sources < 2) | (total < 10), "thin").when((sources < 4) | (total < 40), "medium").otherwise("strong")
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))


def area_counts(labelled: DataFrame) -> DataFrame:
    """source_id, area, count of ``labelled`` (source_id, labels)."""
    return labelled.select("source_id", F.explode("labels").alias("area")).groupBy("source_id", "area").count()


def coverage_map(counts: DataFrame, k: int = 8) -> DataFrame:
    """area, total, sources, status, top (source:count of the k largest)."""
    place = F.row_number().over(Window.partitionBy("area").orderBy(F.desc("count"), "source_id"))
    ranked = counts.withColumn("place", place)
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= k, F.struct("place", "source_id", "count")))), lambda t: F.concat_ws(":", t["source_id"], t["count"])), ",")
    out = ranked.groupBy("area").agg(F.sum("count").alias("total"), F.count("*").alias("sources"), top.alias("top"))
    return out.withColumn("status", area_status(F.col("total"), F.col("sources")))


def warnings(posts: Column, texts: Column, metadata: Column, embedded: Column, indexed: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(posts == 0, F.lit("no posts")),
            F.when((texts == 0) & (posts > 0), F.lit("no text posts")),
            F.when((metadata == 0) & (texts > 0), F.lit("no metadata")).when((texts > 0) & (metadata / F.greatest(texts, F.lit(1)) < 0.5), F.lit("metadata below 50%")),
            F.when((embedded == 0) & (texts > 0), F.lit("no embeddings")).when((texts > 0) & (embedded / F.greatest(texts, F.lit(1)) < 0.8), F.lit("embeddings below 80%")),
            F.when((indexed == 0) & (texts > 0), F.lit("no index rows")),
        )
    )


def representatives(labelled: DataFrame, k: int = 6) -> DataFrame:
    """Up to k documents of each source, best first, each of the first round with an area that none before has; then the best of the rest.

    What is chosen depends on what was chosen before, so a source's candidates are gone through in order; of a source
    only the first document of each set of areas, and its k best, can be chosen, and only those are brought together.
    """
    best = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("n"), "doc_id"))  # its limit is taken below the shuffle
    top = labelled.withColumn("place", best).filter(F.col("place") <= k).select("source_id", "doc_id", "labels", "n")
    key = F.struct((-F.col("n")).alias("n"), "doc_id")
    first = labelled.groupBy("source_id", "labels").agg(F.min(key).alias("f")).select("source_id", F.col("f.doc_id").alias("doc_id"), "labels", (-F.col("f.n")).alias("n"))
    candidates = top.unionByName(first).dropDuplicates(["source_id", "doc_id"])

    def choose(own):
        own = own.sort_values(["n", "doc_id"], ascending=[False, True])
        seen, picked = set(), []
        for row in own.itertuples():
            if len(picked) < k and set(row.labels) - seen:
                seen |= set(row.labels)
                picked.append(row.Index)
        for i in own.index:
            if len(picked) < k and i not in picked:
                picked.append(i)
        out = own.loc[picked, ["source_id", "doc_id"]]
        return out.assign(pos=range(1, len(out) + 1))

    return candidates.select("source_id", "doc_id", "labels", "n").groupBy("source_id").applyInPandas(choose, "source_id string, doc_id long, pos int")


def spread(df: DataFrame, k: int, by: str, order: list[Column], bucket: Column) -> DataFrame:
    """About k rows of each group, evenly spread over its order; ``bucket`` as in ``numbered``."""
    placed = numbered(df, by, order, bucket, "pos", "size").withColumn("pos", F.col("pos") - 1).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("size") / k)))
    return placed.filter((F.pmod("pos", "step") == 0) & (F.floor(F.col("pos") / F.col("step")) < k)).drop("size")
