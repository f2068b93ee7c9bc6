"""The knowledge matrix: contributions of sources to cells, rollups over them, and what a candidate source would add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("utility", "evidence", "depth", "practicality", "novelty")
#: Weights of the metrics, and their sum.
WEIGHTS = {"utility": 1.3, "evidence": 1.2, "depth": 1.0, "practicality": 1.0, "novelty": 0.8}
TOTAL = 5.3


def weighted_score() -> Column:
    total = F.lit(0.0)
    for name, w in WEIGHTS.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * w
    return F.round(total / TOTAL, 3)


def normalised(cells: DataFrame, aliases: DataFrame) -> DataFrame:
    """``cells`` with subdomains replaced by what the aliases (kind, name, canonical) say; ``aliased`` tells where. The aliases are a fixed vocabulary."""
    names = F.broadcast(aliases.filter("kind = 'subdomain'").select(F.col("name").alias("subdomain"), "canonical"))
    out = cells.join(names, "subdomain", "left").withColumn("aliased", F.col("canonical").isNotNull())
    return out.withColumn("subdomain", F.coalesce("canonical", "subdomain")).drop("canonical")


def best_per_source(contributions: DataFrame, keys: list[str]) -> DataFrame:
    order = [F.desc("score"), (F.col("role") == "primary").desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("cell_id"), F.col("intent")]
    best = F.row_number().over(Window.partitionBy(*keys, "source_id").orderBy(*order))
    return contributions.withColumn("__best", best).filter("__best = 1").drop("__best")


def coverage_class(n: Column, primary: Column, best: Column) -> Column:
    return (
        F.when(n == 0, "none").when((primary >= 2) & (best >= 4.3), "strong_multi_source").when((primary >= 1) & (best >= 4.3), "strong_single_source").when(best >= 3.5, "moderate").otherwise("thin")
    )


def redundancy_class(n: Column, strong: Column) -> Column:
    return F.when(strong >= 4, "high").when(strong == 3, "medium").when(strong == 2, "low").when(n > 0, "single_source").otherwise("none")


def overlap_class(sources: Column, cells: Column) -> Column:
    return (
        F.when((cells > 1) & (sources > 1), "related_multi_source").when((cells == 1) & (sources > 1), "exact_multi_source").when((cells > 1) & (sources == 1), "single_expert_multi_cell")
        .when(sources > 0, "single_source").otherwise("none")
    )


def cells_of(contributions: DataFrame) -> DataFrame:
    """cell_id, sources, primary_sources, best, coverage, redundancy by the best contribution of each source."""
    best = best_per_source(contributions, ["cell_id"])
    out = best.groupBy("cell_id").agg(F.count("*").alias("sources"), F.count_if(F.col("role") == "primary").alias("primary_sources"), F.max("score").alias("best"), F.count_if(F.col("score") >= 4.0).alias("strong"))
    out = out.withColumn("coverage", coverage_class(F.col("sources"), F.col("primary_sources"), F.col("best")))
    return out.withColumn("redundancy", redundancy_class(F.col("sources"), F.col("strong")))


def rollups(contributions: DataFrame) -> DataFrame:
    """kind, rollup_id, sources, cells, contributions, best, coverage, redundancy, overlap at three levels: domain, domain and intent, intent.

    Levels are keys of each contribution, made before the grouping, so that all levels are one shuffle; a
    contribution with several intents counts once for its domain.
    """
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("rollup_id"))
    intents = F.col("intents")
    keys = F.concat(F.array(key("domain", F.col("domain"))), F.transform(intents, lambda i: key("domain_intent", F.concat_ws("/", F.col("domain"), i))), F.transform(intents, lambda i: key("intent", i)))
    rows = contributions.withColumn("k", F.explode(keys)).select("k.kind", "k.rollup_id", "source_id", "cell_id", "score", "role", "confidence", "intent")
    all_of = rows.groupBy("kind", "rollup_id").agg(F.count_distinct("source_id").alias("sources"), F.count_distinct("cell_id").alias("cells"), F.count("*").alias("contributions"))
    best = best_per_source(rows, ["kind", "rollup_id"]).groupBy("kind", "rollup_id").agg(F.max("score").alias("best"), F.count_if(F.col("role") == "primary").alias("primary_sources"), F.count_if(F.col("score") >= 4.0).alias("strong"))
    out = all_of.join(best, ["kind", "rollup_id"])
    out = out.withColumn("coverage", coverage_class(F.col("sources"), F.col("primary_sources"), F.col("best"))).withColumn("redundancy", redundancy_class(F.col("sources"), F.col("strong")))
    return out.withColumn("overlap", overlap_class(F.col("sources"), F.col("cells")))


def confidence_5(value: Column) -> Column:
    """Confidences from 0 to 1 brought to the scale of 5; null below 0."""
    return F.when(value < 0, None).when(value <= 1, F.round(value * 5, 3)).otherwise(value)


def impact(candidates: DataFrame) -> Column:
    """The class of what a candidate's cell adds, by an ordered cascade over: score, role, confidence, refs, flags, exact (cell known), exact_coverage, exact_best, related (rollup known)."""
    c, lifted = F.col, (F.col("exact_coverage").isin("thin", "moderate")) | (F.col("score") >= F.col("exact_best") + 0.25)
    strong = (c("role") == "primary") & (c("score") >= 4.0)
    return (
        F.when(c("role").isin("weak", "avoid") | (c("score") < 3.3), "noise_risk")
        .when(confidence_5(c("confidence")) < 3, "needs_probe")
        .when(c("refs") == 0, "needs_probe")
        .when(c("flags") > 0, "taxonomy_extension")
        .when(c("exact") & lifted, "deepens_existing_cell")
        .when(c("exact"), "likely_duplicate")
        .when(c("related") & strong, "adds_adjacent_viewpoint")
        .when(c("related"), "needs_probe")
        .when(strong, "fills_gap")
        .otherwise("needs_probe")
    )


POSITIVE = ("fills_gap", "adds_adjacent_viewpoint", "deepens_existing_cell")


def recommendation(total: Column, positive: Column, duplicate: Column, probe: Column, taxonomy: Column, noise: Column, caveat: Column) -> Column:
    return (
        F.when(total == 0, "insufficient_passport_data")
        .when(caveat & (positive >= 1) & (noise == 0), "overlap_heavy_needs_stronger_review")
        .when((positive >= 2) & (duplicate <= positive) & (noise == 0), "promising_needs_human_review")
        .when((positive >= 1) & ((probe > 0) | (taxonomy > 0)), "promising_but_probe_or_taxonomy_review")
        .when(duplicate == total, "likely_duplicate_or_low_increment")
        .when(taxonomy > 0, "taxonomy_review_needed")
        .when((noise > 0) & (positive == 0), "weak_or_noisy")
        .otherwise("probe_needed")
    )


def against_others(contributions: DataFrame) -> DataFrame:
    """Each source's cells against what all other sources have: leave-one-out, without a join of sources with sources.

    For a cell, what the others' best is follows from the two best sources of the cell, and how many others there are
    from their number; so for rollups. One row per source and cell.
    """
    own = best_per_source(contributions, ["cell_id"])
    by_cell = Window.partitionBy("cell_id")
    ranked = own.withColumn("place", F.row_number().over(by_cell.orderBy(F.desc("score"), "source_id")))
    top = ranked.filter("place <= 2").groupBy("cell_id").agg(F.max(F.when(F.col("place") == 1, F.col("source_id"))).alias("top_source"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    counts = own.groupBy("cell_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "primary").alias("p"), F.count_if(F.col("score") >= 4.0).alias("s"))
    area = own.groupBy("domain", "intent").agg(F.count_distinct("source_id").alias("area_sources"))
    rows = own.join(top, "cell_id").join(counts, "cell_id").join(area, ["domain", "intent"])
    others_best = F.when(F.col("source_id") == F.col("top_source"), F.col("second")).otherwise(F.col("first"))
    rows = rows.withColumn("exact", F.col("n") > 1).withColumn("exact_best", F.coalesce(others_best, F.lit(0.0))).withColumn("related", F.col("area_sources") > 1)
    others_primary = F.col("p") - (F.col("role") == "primary").cast("long")
    rows = rows.withColumn("exact_coverage", coverage_class(F.col("n") - 1, others_primary, F.col("exact_best")))
    others_strong = F.col("s") - (F.col("score") >= 4.0).cast("long")
    rows = rows.withColumn("exact_redundancy", redundancy_class(F.col("n") - 1, others_strong))
    return rows.withColumn("dense", dense(F.col("n") - 1, F.col("exact_coverage"), F.col("exact_redundancy"), F.col("area_sources") - 1))


#: Sources from which a cell or rollup is dense whatever else it has.
DENSE = 3


def dense(sources: Column, coverage: Column, redundancy: Column, area_sources: Column) -> Column:
    """Whether what is there already is dense: the same cell (of ``sources``), or its domain and intent, which of two sources and more is a multi-source overlap."""
    exact = (sources > 0) & ((coverage == "strong_multi_source") | redundancy.isin("medium", "high") | (sources >= DENSE))
    return exact | (area_sources >= 2)


def density(rows: DataFrame) -> DataFrame:
    """source_id and counts of candidates' cells (``against_others`` with ``class``): overlap_cells, overlap_share, positive_overlap, dense_overlap, dense_positive, clean_gaps, and the caveat with its reasons."""
    overlap, positive = F.col("exact") | F.col("related"), F.col("class").isin(*POSITIVE)
    out = rows.groupBy("source_id").agg(
        F.count("*").alias("total"), F.count_if(overlap).alias("overlap_cells"), F.count_if(overlap & positive).alias("positive_overlap"), F.count_if(overlap & F.col("dense")).alias("dense_overlap"),
        F.count_if(overlap & positive & F.col("dense")).alias("dense_positive"), F.count_if((F.col("class") == "fills_gap") & ~overlap).alias("clean_gaps"), F.count_if(F.col("class") == "likely_duplicate").alias("duplicates"),
    )
    out = out.withColumn("overlap_share", F.round(F.col("overlap_cells") / F.col("total"), 3))
    caveat = F.expr("overlap_share >= 0.5 AND dense_overlap >= 2 AND (duplicates > 0 OR positive_overlap >= 2)")
    said = (("overlap", F.lit(True)), ("dense", F.lit(True)), ("duplicate", F.col("duplicates") > 0), ("adjacent", F.col("positive_overlap") >= 2))
    reasons = F.array_join(F.array_compact(F.array(*(F.when(F.col("caveat") & when, name) for name, when in said))), ",")
    return out.withColumn("caveat", caveat).withColumn("reasons", reasons).drop("total", "duplicates")


def outside(contributions: DataFrame, core: dict[str, list[str]]) -> DataFrame:
    """kind, value, cell_id of each value that isn't in the core vocabulary of its kind."""
    values = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), F.col(k).isin(known).alias("known")) for k, known in core.items()))
    return contributions.select("cell_id", F.explode(values).alias("v")).filter("NOT v.known").select("v.kind", "v.value", "cell_id").distinct()


def closest(best: DataFrame, source: str) -> DataFrame:
    """source_id, exact, related, cells, rollups, best of every other source: its cells that ``source`` has too, or else of a domain and intent that it has. A cell counts once."""
    own = best.filter(F.col("source_id") == source)
    cells = own.select("cell_id", F.lit(True).alias("same")).distinct()
    areas = own.select("domain", "intent").distinct()
    rows = best.filter(F.col("source_id") != source).join(cells, "cell_id", "left").join(areas, ["domain", "intent"], "left_semi")
    same = F.coalesce("same", F.lit(False))
    return rows.groupBy("source_id").agg(
        F.count_if(same).alias("exact"), F.count_if(~same).alias("related"), F.count_distinct("cell_id").alias("cells"), F.count_distinct(F.concat_ws("/", "domain", "intent")).alias("rollups"), F.max("score").alias("best")
    )


def not_exported(cells: DataFrame, exported: DataFrame) -> DataFrame:
    """Cells (source_id, cell_id, weight, ..) of strong and signature weight that the export (source_id, cell_id) lacks."""
    return cells.filter("weight IN ('strong', 'signature')").join(exported.select("source_id", "cell_id"), ["source_id", "cell_id"], "left_anti")


def contract(cells: DataFrame, exported: DataFrame, index: DataFrame, required: list[str]) -> DataFrame:
    """source_id, cells, exported, incomplete (cells without a required column), missing_export, unknown_refs (different ones that ``index``, of source_id and ref, lacks), valid."""
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull()
    by = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    used = cells.select("source_id", F.explode("refs").alias("ref")).distinct()
    out = cells.groupBy("source_id").agg(F.count("*").alias("cells"), F.count_if(lacking).alias("incomplete"))
    for part, name in ((exported, "exported"), (not_exported(cells, exported), "missing_export"), (used.join(index, ["source_id", "ref"], "left_anti"), "unknown_refs")):
        out = out.join(by(part, name), "source_id", "left")
    out = out.fillna(0, ["exported", "missing_export", "unknown_refs"])
    return out.withColumn("valid", F.expr("incomplete = 0 AND exported > 0 AND missing_export = 0 AND unknown_refs = 0"))
