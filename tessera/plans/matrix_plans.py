"""Queries of the knowledge matrix and candidate evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix as X
from ..operators import passports as Z
from ..sources import tables as T
from .registry import query

#: Contributions of nations (sources) to cells of segment, priority and status, scored from 0 to 5 by bounded aggregates.
BASE = """base AS (SELECT n_name AS source_id, c_mktsegment AS domain, o_orderpriority AS subdomain, o_orderstatus AS intent, count(*) AS k, avg(o_totalprice) AS price, max(o_orderkey) % 100 AS h
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
con AS (SELECT source_id, domain, CASE subdomain WHEN '4-NOT SPECIFIED' THEN '5-LOW' ELSE subdomain END AS subdomain, intent, CASE WHEN k >= 2 AND h >= 30 THEN 'primary' WHEN h < 5 THEN 'weak' ELSE 'secondary' END AS role,
 (2 + k % 4)::DOUBLE AS utility, least(5.0, 1 + h / 20)::DOUBLE AS evidence, (h % 5 + 1)::DOUBLE AS depth, (3 + (k % 5) / 2)::DOUBLE AS practicality, least(5.0, round(price / 100000))::DOUBLE AS novelty, (h % 11) / 10.0::DOUBLE AS confidence, h % 4 AS refs FROM base),
sc AS (SELECT *, domain || '/' || subdomain || '/' || intent AS cell_id, round((utility * 1.3::DOUBLE + evidence * 1.2::DOUBLE + depth + practicality + novelty * 0.8::DOUBLE) / 5.3::DOUBLE, 3) AS score FROM con),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY cell_id, source_id ORDER BY score DESC, role = 'primary' DESC, confidence DESC, cell_id, intent) = 1)"""
COVER = "CASE WHEN sources = 0 THEN 'none' WHEN primary_sources >= 2 AND best >= 4.3 THEN 'strong_multi_source' WHEN primary_sources >= 1 AND best >= 4.3 THEN 'strong_single_source' WHEN best >= 3.5 THEN 'moderate' ELSE 'thin' END"
RED = "CASE WHEN strong >= 4 THEN 'high' WHEN strong = 3 THEN 'medium' WHEN strong = 2 THEN 'low' WHEN sources > 0 THEN 'single_source' ELSE 'none' END"
CELLS = f"cells AS (SELECT cell_id, count(*) AS sources, count(*) FILTER (role = 'primary') AS primary_sources, max(score) AS best, count(*) FILTER (score >= 4.0) AS strong FROM best GROUP BY cell_id), cl AS (SELECT *, {COVER} AS coverage, {RED} AS redundancy FROM cells)"


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda n: T.raw(spark, sf_dir, n)
    o = raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    joined = o.join(raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(raw("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    base = joined.groupBy(F.col("n_name").alias("source_id"), F.col("c_mktsegment").alias("domain"), F.col("o_orderpriority").alias("subdomain"), F.col("o_orderstatus").alias("intent")).agg(
        F.count("*").alias("k"), F.avg("o_totalprice").alias("price"), (F.max("o_orderkey") % 100).alias("h")
    )
    k, h, five = F.col("k"), F.col("h"), F.lit(5.0)
    role = F.when((k >= 2) & (h >= 30), "primary").when(h < 5, "weak").otherwise("secondary")
    cells = base.select(
        "source_id", "domain", "subdomain", "intent", role.alias("role"), (2.0 + k % 4).alias("utility"), F.least(five, 1 + h / 20).alias("evidence"), (h % 5 + 1).cast("double").alias("depth"),
        (3 + k % 5 / 2).alias("practicality"), F.least(five, F.round(F.col("price") / 100000)).alias("novelty"), (h % 11 / 10).alias("confidence"), (h % 4).alias("refs"), F.array("intent").alias("intents"),
    )
    aliases = spark.createDataFrame([("subdomain", "4-NOT SPECIFIED", "5-LOW")], "kind string, name string, canonical string")
    rows = X.normalised(cells, aliases)
    return rows.withColumn("cell_id", F.concat_ws("/", "domain", "subdomain", "intent")).withColumn("score", X.weighted_score())


@query(f"WITH {BASE} SELECT source_id, cell_id, role, score FROM sc")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir).select("source_id", "cell_id", "role", "score")


@query(f"WITH {BASE} SELECT source_id, cell_id, score FROM best")
def best_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.best_per_source(contributions(spark, sf_dir), ["cell_id"]).select("source_id", "cell_id", "score")


@query(f"WITH {BASE} SELECT cell_id, source_id, score, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, confidence DESC, source_id) AS rank FROM best QUALIFY rank <= 5")
def best_sources_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import top

    best = X.best_per_source(contributions(spark, sf_dir), ["cell_id"])
    return top(best, 5, [F.desc("score"), F.desc("confidence"), F.col("source_id")], by="cell_id").select("cell_id", "source_id", "score", F.col("rank").cast("long").alias("rank"))


SUMMED = "utility, evidence, depth, practicality, novelty, confidence, score"


@query(f"WITH {BASE} SELECT cell_id, metric, round(avg(v) + 1e-9, 3) AS mean, max(v) AS most FROM (UNPIVOT (SELECT cell_id, {SUMMED} FROM best) ON {SUMMED} INTO NAME metric VALUE v) GROUP BY ALL")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = SUMMED.split(", ")
    best = X.best_per_source(contributions(spark, sf_dir), ["cell_id"]).select("cell_id", *(F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics))
    return best.unpivot("cell_id", metrics, "metric", "v").groupBy("cell_id", "metric").agg(F.round(F.avg("v") + 1e-9, 3).alias("mean"), F.max("v").alias("most"))


@query(f"WITH {BASE}, {CELLS} SELECT cell_id, sources, primary_sources, best, coverage, redundancy FROM cl")
def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cells_of(contributions(spark, sf_dir)).select("cell_id", "sources", "primary_sources", "best", "coverage", "redundancy")


ROLL = f"""k AS (SELECT *, 'domain' AS kind, domain AS rollup_id FROM sc UNION ALL SELECT *, 'domain_intent', domain || '/' || intent FROM sc UNION ALL SELECT *, 'intent', intent FROM sc),
kb AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY kind, rollup_id, source_id ORDER BY score DESC, role = 'primary' DESC, confidence DESC, cell_id, intent) = 1),
ra AS (SELECT kind, rollup_id, count(DISTINCT source_id) AS sources, count(DISTINCT cell_id) AS cells, count(*) AS contributions FROM k GROUP BY ALL),
rb AS (SELECT kind, rollup_id, max(score) AS best, count(*) FILTER (role = 'primary') AS primary_sources, count(*) FILTER (score >= 4.0) AS strong FROM kb GROUP BY ALL),
ro AS (SELECT *, {COVER} AS coverage, {RED} AS redundancy, CASE WHEN cells > 1 AND sources > 1 THEN 'related_multi_source' WHEN cells = 1 AND sources > 1 THEN 'exact_multi_source' WHEN cells > 1 AND sources = 1 THEN 'single_expert_multi_cell' WHEN sources > 0 THEN 'single_source' ELSE 'none' END AS overlap FROM ra JOIN rb USING (kind, rollup_id))"""


@query(f"WITH {BASE}, {ROLL} SELECT kind, rollup_id, sources, cells, contributions, best, coverage, redundancy FROM ro")
def matrix_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rollups(contributions(spark, sf_dir)).select("kind", "rollup_id", "sources", "cells", "contributions", "best", "coverage", "redundancy")


@query(f"WITH {BASE}, {ROLL} SELECT kind, rollup_id, overlap FROM ro")
def rollup_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rollups(contributions(spark, sf_dir)).select("kind", "rollup_id", "overlap")


@query(f"""WITH {BASE} SELECT DISTINCT kind, value, cell_id FROM (SELECT 'subdomain' AS kind, subdomain AS value, cell_id FROM sc WHERE subdomain NOT IN ('1-URGENT', '2-HIGH')
 UNION ALL SELECT 'domain', domain, cell_id FROM sc WHERE domain NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') UNION ALL SELECT 'intent', intent, cell_id FROM sc WHERE intent NOT IN ('O', 'F'))""")
def taxonomy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each kind that are outside of the core vocabulary, by cell."""
    core = {"subdomain": ["1-URGENT", "2-HIGH"], "domain": ["AUTOMOBILE", "BUILDING", "FURNITURE"], "intent": ["O", "F"]}
    return X.outside(contributions(spark, sf_dir), core)


@query(f"""WITH {BASE}, {CELLS}, {ROLL} SELECT count(*) AS cells, count(*) FILTER (coverage = 'strong_multi_source') AS strong_multi, count(*) FILTER (coverage = 'strong_single_source') AS strong_single, count(*) FILTER (coverage = 'moderate') AS moderate, count(*) FILTER (coverage = 'thin') AS thin,
 count(*) FILTER (redundancy = 'high') AS redundant, count(*) FILTER (redundancy = 'single_source') AS single_source, (SELECT count(DISTINCT source_id) FROM sc) AS sources, (SELECT count(*) FROM sc) AS contributions, (SELECT count(*) FROM ro WHERE kind = 'domain') AS domains,
 (SELECT count(*) FROM ro WHERE kind = 'domain_intent') AS domain_intents, (SELECT count(*) FROM ro WHERE kind = 'intent') AS intents, (SELECT count(*) FROM ro WHERE overlap = 'related_multi_source') AS related, (SELECT count(*) FROM ro WHERE overlap = 'exact_multi_source') AS exact FROM cl""")
def matrix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contributions(spark, sf_dir)
    of = lambda c, v, name: F.count_if(F.col(c) == v).alias(name)
    cells = X.cells_of(rows).agg(
        F.count("*").alias("cells"), of("coverage", "strong_multi_source", "strong_multi"), of("coverage", "strong_single_source", "strong_single"), of("coverage", "moderate", "moderate"), of("coverage", "thin", "thin"),
        of("redundancy", "high", "redundant"), of("redundancy", "single_source", "single_source"),
    )
    levels = X.rollups(rows).agg(of("kind", "domain", "domains"), of("kind", "domain_intent", "domain_intents"), of("kind", "intent", "intents"), of("overlap", "related_multi_source", "related"), of("overlap", "exact_multi_source", "exact"))
    return cells.crossJoin(levels).crossJoin(rows.agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("contributions")))


LOO = """oth AS (SELECT b.*, (SELECT count(*) FROM best x WHERE x.cell_id = b.cell_id AND x.source_id <> b.source_id) AS n_oth, coalesce((SELECT max(score) FROM best x WHERE x.cell_id = b.cell_id AND x.source_id <> b.source_id), 0) AS best_oth,
 (SELECT count(*) FROM best x WHERE x.cell_id = b.cell_id AND x.source_id <> b.source_id AND x.role = 'primary') AS p_oth, (SELECT count(DISTINCT source_id) FROM best x WHERE x.domain = b.domain AND x.intent = b.intent) AS area, (SELECT count(*) FROM best x WHERE x.cell_id = b.cell_id AND x.source_id <> b.source_id AND x.score >= 4.0) AS s_oth FROM best b),
im AS (SELECT *, CASE WHEN n_oth = 0 THEN 'none' WHEN p_oth >= 2 AND best_oth >= 4.3 THEN 'strong_multi_source' WHEN p_oth >= 1 AND best_oth >= 4.3 THEN 'strong_single_source' WHEN best_oth >= 3.5 THEN 'moderate' ELSE 'thin' END AS cov FROM oth),
ic AS (SELECT *, CASE WHEN role IN ('weak', 'avoid') OR score < 3.3 THEN 'noise_risk' WHEN round(confidence * 5, 3) < 3 THEN 'needs_probe' WHEN refs = 0 THEN 'needs_probe' WHEN subdomain = '3-MEDIUM' THEN 'taxonomy_extension'
 WHEN n_oth > 0 AND (cov IN ('thin', 'moderate') OR score >= best_oth + 0.25) THEN 'deepens_existing_cell' WHEN n_oth > 0 THEN 'likely_duplicate' WHEN area > 1 AND role = 'primary' AND score >= 4.0 THEN 'adds_adjacent_viewpoint'
 WHEN area > 1 THEN 'needs_probe' WHEN role = 'primary' AND score >= 4.0 THEN 'fills_gap' ELSE 'needs_probe' END AS class FROM im)"""


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a candidate against all others."""
    rows = X.against_others(contributions(spark, sf_dir)).withColumn("flags", (F.col("subdomain") == "3-MEDIUM").cast("int"))
    return rows.withColumn("class", X.impact(rows))


@query(f"WITH {BASE}, {LOO} SELECT source_id, cell_id, class FROM ic")
def candidate_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts(spark, sf_dir).select("source_id", "cell_id", "class")


SUMMARY = """sm AS (SELECT source_id, count(*) AS total, count(*) FILTER (class IN ('fills_gap', 'adds_adjacent_viewpoint', 'deepens_existing_cell')) AS positive, count(*) FILTER (class = 'likely_duplicate') AS duplicate,
 count(*) FILTER (class = 'needs_probe') AS probe, count(*) FILTER (class = 'taxonomy_extension') AS taxonomy, count(*) FILTER (class = 'noise_risk') AS noise, round(count(*) FILTER (n_oth > 0 OR area > 1) / count(*), 3) AS overlap_share FROM ic GROUP BY 1)"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda *names: F.count_if(F.col("class").isin(*names))
    return impacts(spark, sf_dir).groupBy("source_id").agg(
        F.count("*").alias("total"), of(*X.POSITIVE).alias("positive"), of("likely_duplicate").alias("duplicate"), of("needs_probe").alias("probe"), of("taxonomy_extension").alias("taxonomy"), of("noise_risk").alias("noise"),
        F.round(F.count_if(F.col("exact") | F.col("related")) / F.count("*"), 3).alias("overlap_share"),
    )


@query(f"WITH {BASE}, {LOO}, {SUMMARY} SELECT * FROM sm")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir)


DENSITY = """dc AS (SELECT *, n_oth > 0 OR area > 1 AS ov, class IN ('fills_gap', 'adds_adjacent_viewpoint', 'deepens_existing_cell') AS pos, n_oth > 0 AND (cov = 'strong_multi_source' OR s_oth >= 3 OR n_oth >= 3) OR area > 2 AS dense FROM ic),
dn AS (SELECT source_id, count(*) FILTER (ov) AS overlap_cells, round(count(*) FILTER (ov) / count(*), 3) AS overlap_share, count(*) FILTER (ov AND pos) AS positive_overlap, count(*) FILTER (ov AND dense) AS dense_overlap,
 count(*) FILTER (ov AND pos AND dense) AS dense_positive, count(*) FILTER (class = 'fills_gap' AND NOT ov) AS clean_gaps, count(*) FILTER (class = 'likely_duplicate') AS dup FROM dc GROUP BY 1),
dy AS (SELECT *, overlap_share >= 0.5 AND dense_overlap >= 2 AND (dup > 0 OR positive_overlap >= 2) AS caveat FROM dn)"""


@query(f"""WITH {BASE}, {LOO}, {DENSITY} SELECT * EXCLUDE (dup), CASE WHEN caveat THEN 'overlap,dense' || CASE WHEN dup > 0 THEN ',duplicate' ELSE '' END || CASE WHEN positive_overlap >= 2 THEN ',adjacent' ELSE '' END ELSE '' END AS reasons FROM dy""")
def density_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.density(impacts(spark, sf_dir))


@query(f"""WITH {BASE}, {LOO}, {SUMMARY}, {DENSITY} SELECT source_id, CASE WHEN total = 0 THEN 'insufficient_passport_data' WHEN caveat AND positive >= 1 AND noise = 0 THEN 'overlap_heavy_needs_stronger_review'
 WHEN positive >= 2 AND duplicate <= positive AND noise = 0 THEN 'promising_needs_human_review' WHEN positive >= 1 AND (probe > 0 OR taxonomy > 0) THEN 'promising_but_probe_or_taxonomy_review' WHEN duplicate = total THEN 'likely_duplicate_or_low_increment'
 WHEN taxonomy > 0 THEN 'taxonomy_review_needed' WHEN noise > 0 AND positive = 0 THEN 'weak_or_noisy' ELSE 'probe_needed' END AS recommendation FROM sm JOIN dy USING (source_id)""")
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, caveats = F.col, density_summary(spark, sf_dir).select("source_id", "caveat")
    return summary(spark, sf_dir).join(caveats, "source_id").select("source_id", X.recommendation(c("total"), c("positive"), c("duplicate"), c("probe"), c("taxonomy"), c("noise"), c("caveat")).alias("recommendation"))


@query(f"""WITH {BASE}, own AS (SELECT DISTINCT cell_id, domain, intent FROM best WHERE source_id = 'NATION_3'), ex AS (SELECT b.source_id, b.cell_id, b.domain, b.intent, b.score FROM best b JOIN own USING (cell_id) WHERE b.source_id <> 'NATION_3'),
re AS (SELECT b.source_id, b.cell_id, b.domain, b.intent, b.score FROM best b WHERE b.source_id <> 'NATION_3' AND b.cell_id NOT IN (SELECT cell_id FROM own) AND EXISTS (SELECT 1 FROM own o WHERE o.domain = b.domain AND o.intent = b.intent))
SELECT source_id, count(*) FILTER (k = 'exact') AS exact, count(*) FILTER (k = 'related') AS related, count(DISTINCT cell_id) AS cells, count(DISTINCT domain || '/' || intent) AS rollups, max(score) AS best FROM (SELECT 'exact' AS k, * FROM ex UNION ALL SELECT 'related', * FROM re) GROUP BY 1""")
def closest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other sources by what they have of one source's cells, or else of its domains and intents."""
    return X.closest(X.best_per_source(contributions(spark, sf_dir), ["cell_id"]), "NATION_3")


PASSPORT = "w AS (SELECT *, CASE WHEN score >= 4.3 THEN 'signature' WHEN score >= 3.8 THEN 'strong' WHEN score >= 3 THEN 'normal' ELSE 'weak' END AS weight, depth <> 3 AS exported, length(source_id) % 2 = 0 AS knows FROM best)"


def passport(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells with weights and refs, those of them that are exported, and the refs that each source's index knows."""
    score = F.col("score")
    weight = F.when(score >= 4.3, "signature").when(score >= 3.8, "strong").when(score >= 3, "normal").otherwise("weak")
    refs = F.transform(F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda i: i <= F.col("refs")), lambda i: F.concat(F.lit("P"), i))
    cells = X.best_per_source(contributions(spark, sf_dir), ["cell_id"]).withColumns({"weight": weight, "refs": refs})
    known = F.when(F.char_length("source_id") % 2 == 0, F.array(*map(F.lit, ("P1", "P2", "P3")))).otherwise(F.array(*map(F.lit, ("P1", "P2"))))
    return cells, cells.filter("depth <> 3"), cells.select("source_id").distinct().select("source_id", F.explode(known).alias("ref"))


@query(f"""WITH {BASE}, {PASSPORT}, v AS (SELECT source_id, count(*) AS cells, 0::BIGINT AS incomplete, count(*) FILTER (exported) AS exported, count(*) FILTER (weight IN ('strong', 'signature') AND NOT exported) AS missing_export, bool_or(refs >= 3 AND NOT knows)::BIGINT AS unknown_refs FROM w GROUP BY 1)
SELECT *, exported > 0 AND missing_export = 0 AND unknown_refs = 0 AS valid FROM v""")
def passport_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of each source's passport: complete cells, an export without gaps, known refs only."""
    return X.contract(*passport(spark, sf_dir), ["domain", "subdomain", "intent", "score"])


@query(f"""WITH {BASE}, {PASSPORT}, m AS (SELECT source_id, max(refs) AS m, bool_or(knows) AS knows FROM w GROUP BY 1), h AS (SELECT source_id, unnest(['P2', 'P3', 'C4']) AS id, unnest([m >= 2, m >= 3 AND knows, true]) AS used FROM m)
SELECT source_id, 'cell' AS kind, cell_id AS id, NOT exported AS derived, CASE WHEN NOT exported THEN 'strong' ELSE '' END AS coverage_level, CASE WHEN NOT exported THEN 'primary' ELSE '' END AS source_role,
 CASE WHEN exported THEN '' WHEN depth >= 4.5 THEN 'deep_practitioner' WHEN depth >= 2.5 THEN 'practical' WHEN depth > 0 THEN 'commentary' ELSE 'none' END AS depth_level FROM w WHERE exported OR (weight IN ('strong', 'signature') AND refs > 0)
UNION ALL SELECT source_id, 'ref', id, true, '', '', '' FROM h WHERE used UNION ALL SELECT source_id, 'ref', 'P1', false, '', '', '' FROM m""")
def passport_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passports as nested JSON, with what they lacked: in the export the cells of strong and signature weight, in the index the refs that stand anywhere in them."""
    cells, exported, index = passport(spark, sf_dir)
    own = lambda c: F.struct(c("domain").alias("domain_id"), c("subdomain").alias("subdomain_id"), F.array(c("intent")).alias("query_intent_ids"), c("weight").alias("recommended_matrix_weight"), c("depth").alias("depth_score_0_5"), c("refs").alias("evidence_refs"))
    by = lambda rows, name: rows.groupBy("source_id").agg(F.sort_array(F.collect_list(own(F.col))).alias(name))
    made = by(cells, "matrix_cells").join(by(exported, "cells"), "source_id", "left")
    deep = F.lit('{"a": [[{"b": {"c": ["x", "C4", 7, null]}}], "P", "P1x"]}')
    json = F.to_json(F.struct("matrix_cells", F.struct(F.coalesce("cells", F.array()).alias("cells"), F.lit("v1").alias("version")).alias("matrix_export"), F.parse_json(deep).alias("notes"), F.array(F.struct(F.lit("P1").alias("source_ref"))).alias("source_ref_index_used")))
    known = index.unionByName(index.select("source_id").distinct().withColumn("ref", F.lit("C4")))
    out = Z.stored(Z.normalized(made.select("source_id", F.parse_json(json).alias("passport")), known, "^[PC][0-9]$"))
    v, text = F.col("v"), lambda path: F.coalesce(F.try_variant_get(F.col("v"), path, "string"), F.lit(""))
    listed = lambda path: out.select("source_id", F.explode(F.try_variant_get("passport", path, "array<variant>")).alias("v"))
    rows = listed("$.matrix_export.cells").select("source_id", F.lit("cell").alias("kind"), Z.cell_key(v).alias("id"), (text("$.derived_from") != "").alias("derived"), *(text(f"$.{c}").alias(c) for c in ("coverage_level", "source_role", "depth_level")))
    none = [F.lit("").alias(c) for c in ("coverage_level", "source_role", "depth_level")]
    return rows.unionByName(listed("$.source_ref_index_used").select("source_id", F.lit("ref").alias("kind"), text("$.source_ref").alias("id"), (text("$.why_used") != "").alias("derived"), *none))
