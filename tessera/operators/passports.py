"""Passports of sources as nested JSON of any shape (VARIANT): the refs in them, wherever they stand, and cells that the export forgot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: A ref of a source (a post, or a comment on one, by their numbers), weights that are worth an export, and the note on an entry that was added.
REF = r"^P[0-9]{4}(\.C[0-9]{4})?$"
WEIGHTS = ("strong", "signature")
WHY = "Cited elsewhere in passport; hydrated by deterministic post-processor."
#: Scores of a cell and their names in the export.
SCORES = {
    "depth": "depth_score_0_5", "practicality": "practicality_score_0_5", "evidence_quality": "evidence_quality_score_0_5", "source_utility": "source_utility_score_0_5",
    "intrinsic_distinctiveness": "intrinsic_distinctiveness_score_0_5", "anti_hype": "anti_hype_score_0_5", "community_signal": "comment_signal_score_0_5",
}


def got(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def listed(v: Column, path: str) -> Column:
    """The elements of an array in a passport, none if it isn't there."""
    return F.coalesce(got(v, path, "array<variant>"), F.array().cast("array<variant>"))


def stored(passports: DataFrame) -> DataFrame:
    """``passports`` (source_id, passport) as a table, so that they are made once."""
    text = written(passports.select("source_id", F.to_json("passport").alias("passport")), "passports")
    return text.select("source_id", F.parse_json("passport").alias("passport"))


def refs_in(passports: DataFrame, pattern: str = REF) -> DataFrame:
    """source_id, ref of every string in ``passports`` (source_id, passport) that is a ref, at any depth: each round opens the objects and arrays of the one before, until none is left."""
    spark = passports.sparkSession
    rest, found = passports.select("source_id", F.col("passport").alias("v")), None
    while True:
        kind = F.schema_of_variant("v")
        texts = rest.filter(kind == "STRING").select("source_id", got(F.col("v"), "$").alias("ref")).filter(F.col("ref").rlike(pattern))
        found = texts if found is None else found.unionByName(texts)
        inner = rest.filter(kind.startswith("OBJECT<") | kind.startswith("ARRAY<")).withColumnRenamed("v", "whole")
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer())).select("source_id", F.to_json("value").alias("v"))
        rest = written(opened, "opened").select("source_id", F.parse_json("v").alias("v"))
        if rest.isEmpty():
            return found.distinct()


def hydrated(passports: DataFrame, index: DataFrame, pattern: str = REF) -> DataFrame:
    """``passports`` (source_id, passport) with the index entries (source_id, ref and others of ``index``) of refs that are used but not among their own, in order, behind those in ``source_ref_index_used``; and how many as ``hydrated``."""
    passports = stored(passports)
    own = passports.select("source_id", F.explode(listed(F.col("passport"), "$.source_ref_index_used")).alias("e")).select("source_id", got(F.col("e"), "$.source_ref").alias("ref"))
    wanted = refs_in(passports, pattern).join(own, ["source_id", "ref"], "left_anti").join(index, ["source_id", "ref"])
    rest = [F.col(c) for c in index.columns if c not in ("source_id", "ref")]
    entry = F.struct(F.col("ref").alias("source_ref"), *rest, F.lit(WHY).alias("why_used"))
    new = wanted.groupBy("source_id").agg(F.array_sort(F.collect_list(entry)).alias("new"))
    entries = F.transform(F.coalesce("new", F.array()), lambda e: F.to_variant_object(e))
    out = passports.join(new, "source_id", "left")
    used = F.concat(listed(F.col("passport"), "$.source_ref_index_used"), entries)
    return out.select("source_id", "passport", used.alias("__used"), F.coalesce(F.size("new"), F.lit(0)).alias("hydrated")).withColumn("passport", with_key(F.col("passport"), "source_ref_index_used", F.to_json("__used"))).drop("__used")


def with_key(passport: Column, key: str, json: Column) -> Column:
    """The passport with ``json`` under a key of its own level."""
    rest = F.map_filter(got(passport, "$", "map<string,variant>"), lambda k, _: k != key)
    return F.parse_json(F.to_json(F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(json)))))


def cell_key(cell: Column) -> Column:
    """Domain, subdomain and first intent of a cell; null if one is missing."""
    parts = [F.nullif(got(cell, p), F.lit("")) for p in ("$.domain_id", "$.subdomain_id", "$.query_intent_ids[0]")]
    return F.concat(parts[0], F.lit("/"), parts[1], F.lit("/"), parts[2])


def exported_cell(cell: Column) -> Column:
    """What the export says of a cell that it forgot, as JSON."""
    weight = F.lower(F.trim(F.coalesce(got(cell, "$.recommended_matrix_weight"), F.lit(""))))
    score = lambda name: F.coalesce(got(cell, f"$.{name}", "double"), F.lit(0.0))
    by = lambda strong, normal, weak, other: F.when(weight.isin(*WEIGHTS), strong).when(weight == "normal", normal).when(weight == "weak", weak).otherwise(other)
    depth = score("depth_score_0_5")
    fields = {
        "cell_id": cell_key(cell), "domain_id": got(cell, "$.domain_id"), "subdomain_id": got(cell, "$.subdomain_id"), "subdomain_name": got(cell, "$.subdomain_name"), "query_intent_ids": got(cell, "$.query_intent_ids", "array<string>"),
        "coverage_level": by("strong", "moderate", "thin", "none"), "source_role": by("primary", "supporting", "weak", "avoid"),
        "depth_level": F.when(depth >= 4.5, "deep_practitioner").when(depth >= 2.5, "practical").when(depth > 0, "commentary").otherwise("none"),
        "scores": F.struct(*(score(c).alias(name) for name, c in SCORES.items())), "matrix_update_role": F.lit("needs_matrix_compare"), "evidence_refs": got(cell, "$.evidence_refs", "array<string>"),
        "derived_from": F.lit("matrix_cells"), "repair_reason": F.lit("matrix_export_omitted_strong_or_signature_cell"), "confidence": got(cell, "$.confidence", "double"),
    }
    return F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))


def repaired(passports: DataFrame) -> DataFrame:
    """``passports`` (source_id, passport) whose export (``matrix_export.cells``) also has the cells of ``matrix_cells`` of strong or signature weight that it lacked and that have refs; ``repaired`` and ``skipped``: keys of those added, and of those without refs or without a key of their own."""
    p = F.col("passport")
    cells, export = listed(p, "$.matrix_cells"), listed(p, "$.matrix_export.cells")
    strong = F.filter(cells, lambda c: F.lower(F.trim(F.coalesce(got(c, "$.recommended_matrix_weight"), F.lit("")))).isin(*WEIGHTS))
    rows = passports.select(*passports.columns, export.alias("__export"), F.transform(strong, lambda c: F.struct(cell_key(c).alias("key"), (F.size(F.coalesce(got(c, "$.evidence_refs", "array<variant>"), F.array().cast("array<variant>"))) > 0).alias("refs"), c.alias("c"))).alias("__strong"))
    there = F.transform("__export", cell_key)
    lacking = F.filter("__strong", lambda s: s["key"].isNull() | ~F.array_contains(F.array_compact(there), F.coalesce(s["key"], F.lit(""))))
    rows = rows.withColumn("__lacking", lacking)
    fit = F.filter("__lacking", lambda s: s["key"].isNotNull() & s["refs"])
    first = F.filter(fit, lambda s, i: F.array_position(F.transform(fit, lambda x: x["key"]), s["key"]) == i + 1)
    rows = rows.withColumn("__added", first)
    skipped = F.transform(F.filter("__lacking", lambda s: s["key"].isNull() | ~s["refs"]), lambda s: F.coalesce(s["key"], F.lit("missing_required_identity")))
    whole = F.concat(F.transform("__export", lambda c: F.to_json(c)), F.transform("__added", lambda s: exported_cell(s["c"])))
    export_rest = F.map_filter(F.coalesce(got(p, "$.matrix_export", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: k != "cells")
    export_json = F.to_json(F.map_concat(export_rest, F.create_map(F.lit("cells"), F.parse_json(F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]"))))))
    out = rows.withColumn("passport", with_key(p, "matrix_export", export_json)).withColumn("repaired", F.transform("__added", lambda s: s["key"])).withColumn("skipped", skipped)
    return out.select(*passports.columns, "repaired", "skipped")


def normalized(passports: DataFrame, index: DataFrame, pattern: str = REF) -> DataFrame:
    """``hydrated``, then ``repaired``."""
    return repaired(hydrated(passports, index, pattern))
