"""Queries of corpus coverage and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import retrieval as R
from ..operators.funnel import IDS
from ..operators.numbering import numbered
from ..sources import tables as T
from ..sources.shared import written
from .registry import query

D = T.DOCS_SQL
#: Rules over words of the synthetic corpus; a caller brings its own.
AREAS = {
    "north": ["thin", "from"], "south": ["reth", "une re"], "east": ["la", "est"], "west": ["and", "of the"], "inner": ["der", "von ein"], "outer": ["que", "ció"], "upper": ["les", "tion"], "lower": ["thion"],
    "near": ["blethe", "ouren"], "far": ["eral"], "rest": ["license", "rights reserved"], "news": ["der", "that"],
}
DEPTHS = {"benchmark": ["ouren"], "case_study": ["blethe"], "howto": ["von ein"], "analysis": ["thion"], "opinion": ["license"], "question": ["?"]}
NEWS = (*K.NEWS, "eral", "une re")
RANKS = {"benchmark": 5, "case_study": 4, "howto": 3, "analysis": 3, "opinion": 2, "question": 1, "announcement_or_news": 1, "low_signal": 0}
LABELLED = f"""lt AS (SELECT *, {K.DESCRIBED_SQL} FROM docs WHERE length(text) > 30), l0 AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {K.has_any_sql(AREAS[a])} THEN '{a}' END" for a in AREAS)}], lambda x: x IS NOT NULL) AS ls FROM lt),
lab AS (SELECT * EXCLUDE (low, tokens, ls), CASE WHEN len(ls) > 1 THEN list_filter(ls, lambda x: x <> 'news') ELSE ls END AS labels FROM l0)"""
COUNTS = f"WITH {D}, {LABELLED}, ac AS (SELECT source_id, area, count(*) AS count FROM (SELECT source_id, unnest(labels) AS area FROM lab) GROUP BY ALL)"
STATUS = "CASE WHEN total = 0 OR sources = 0 THEN 'gap' WHEN sources < 2 OR total < 10 THEN 'thin' WHEN sources < 4 OR total < 40 THEN 'medium' ELSE 'strong' END"


STATUS_SQL = f"ar AS (SELECT unnest({list(AREAS)}) AS area), aa AS (SELECT area, coalesce(sum(count), 0) AS total, count(source_id) AS sources FROM ar LEFT JOIN ac USING (area) GROUP BY area), am AS (SELECT *, {STATUS} AS status FROM aa)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.eligible(T.dealt(T.docs(spark, sf_dir)))
    return d.select("doc_id", "source_id", "n", K.area_labels(F.col("text"), AREAS, "news").alias("labels"))


@query(f"WITH {D}, {LABELLED} SELECT doc_id, array_to_string(labels, ',') AS labels FROM lab")
def label_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query(f"{COUNTS} SELECT source_id, area, count AS n FROM ac")
def label_explode_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.area_counts(labelled(spark, sf_dir)).withColumnRenamed("count", "n")


DEPTH = "CASE " + " ".join(f"WHEN {K.has_any_sql(t)} THEN '{d}'" for d, t in DEPTHS.items()) + f" WHEN {K.has_any_sql(NEWS)} THEN 'announcement_or_news' WHEN length(trim(text, E' \\t\\n\\r\\f\\v')) < 220 THEN 'low_signal' ELSE 'announcement_or_news' END"
DEPTH_ROWS = f"dd AS (SELECT *, {DEPTH} AS depth FROM (SELECT *, {K.DESCRIBED_SQL} FROM documents))"


@query(f"WITH {DEPTH_ROWS} SELECT doc_id, depth FROM dd")
def label_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).select("doc_id", K.depth_label(F.col("text"), DEPTHS, news=NEWS).alias("depth"))


@query(f"WITH {DEPTH_ROWS} SELECT doc_id, CASE depth {" ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items())} END AS rank FROM dd")
def depth_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))
    return T.docs(spark, sf_dir).select("doc_id", F.element_at(ranks, K.depth_label(F.col("text"), DEPTHS, news=NEWS)).alias("rank"))


@query("SELECT doc_id, array_to_string(list_filter(['ouren', 'blethe', 'von ein', 'tion'], lambda t: contains(lower(text), t)), ',') AS terms FROM documents")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("ouren", "blethe", "von ein", "tion")))
    return T.docs(spark, sf_dir).select("doc_id", F.array_join(F.filter(terms, lambda t: F.contains(F.lower("text"), t)), ",").alias("terms"))


@query(f"{COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY count DESC, source_id) AS k FROM ac), m AS (SELECT area, sum(count)::BIGINT AS total, count(*) AS sources, string_agg(source_id || ':' || count, ',' ORDER BY k) FILTER (k <= 8) AS top FROM r GROUP BY area) SELECT *, {STATUS} AS status FROM m")
def coverage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.coverage_map(K.area_counts(labelled(spark, sf_dir)))


def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    total = rows.groupBy("source_id").agg(F.count("*").alias("texts"))
    return K.area_counts(rows).join(total, "source_id").withColumn("strength", K.strength(F.col("count"), F.col("texts")))


@query(f"{COUNTS}, t AS (SELECT source_id, count(*) AS texts FROM lab GROUP BY 1) SELECT source_id, area, CASE WHEN count >= 40 AND count / texts >= 0.10 THEN 'strong' WHEN count >= 12 AND count / texts >= 0.04 THEN 'medium' ELSE 'thin' END AS strength FROM ac JOIN t USING (source_id)")
def coverage_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strengths(spark, sf_dir).select("source_id", "area", "strength")


@query(f"{COUNTS}, t AS (SELECT source_id, count(*) AS texts FROM lab GROUP BY 1) SELECT source_id, area, round(count / texts, 4) AS ratio FROM ac JOIN t USING (source_id)")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strengths(spark, sf_dir).select("source_id", "area", K.ratio(F.col("count"), F.col("texts")).alias("ratio"))


PASS = f"""WITH {D}, p AS (SELECT source_id, count(*) AS posts, count(*) FILTER (length(text) > 30) AS texts, count(l.doc_id) AS metadata, count(*) FILTER (e.vec_id IS NOT NULL AND length(text) > 30) AS embedded,
 strftime(min(created_at), '%Y-%m-%d') AS first, strftime(max(created_at), '%Y-%m-%d') AS last, count(*) FILTER (n >= 2400) AS long FROM docs d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY source_id)"""


def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.docs(spark, sf_dir)
    rows = d.join(T.raw(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("meta")), "doc_id", "left").join(T.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("vec")), "doc_id", "left")
    day, is_text = lambda c: F.date_format(c, "yyyy-MM-dd"), F.char_length("text") > 30
    return rows.groupBy("source_id").agg(
        F.count("*").alias("posts"), F.count_if(is_text).alias("texts"), F.count("meta").alias("metadata"), F.count_if(F.col("vec").isNotNull() & is_text).alias("embedded"),
        day(F.min("created_at")).alias("first"), day(F.max("created_at")).alias("last"), F.count_if(F.col("n") >= 2400).alias("long"),
    )


@query(f"{PASS} SELECT * FROM p")
def source_passport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passports(spark, sf_dir)


@query(f"""{PASS} SELECT source_id, array_to_string(list_filter([CASE WHEN posts = 0 THEN 'no posts' END, CASE WHEN texts = 0 AND posts > 0 THEN 'no text posts' END,
 CASE WHEN metadata = 0 AND texts > 0 THEN 'no metadata' WHEN texts > 0 AND metadata / texts < 0.5 THEN 'metadata below 50%' END, CASE WHEN embedded = 0 AND texts > 0 THEN 'no embeddings' WHEN texts > 0 AND embedded / texts < 0.8 THEN 'embeddings below 80%' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM p""")
def warnings_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return passports(spark, sf_dir).select("source_id", F.array_join(K.warnings(c("posts"), c("texts"), c("metadata"), c("embedded"), c("texts")), "; ").alias("warnings"))


@query(f"{COUNTS}, {STATUS_SQL} SELECT 'area' AS kind, area AS name, status AS what FROM am WHERE status IN ('gap', 'thin') UNION ALL SELECT * FROM ({PASS} SELECT 'source', source_id, 'no metadata' FROM p WHERE metadata = 0 AND texts > 0 UNION ALL SELECT 'source', source_id, 'embedding gap' FROM p WHERE texts > 0 AND embedded / texts < 0.8)")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that are thin or missing (also those that no text has), and sources without metadata or with embeddings of less than 0.8 of their texts."""
    c, p = F.col, passports(spark, sf_dir)
    found = K.coverage_map(K.area_counts(labelled(spark, sf_dir))).select("area", "status")
    every = spark.createDataFrame([(a,) for a in AREAS], "area string")
    areas = every.join(found, "area", "left").select(F.lit("area").alias("kind"), F.col("area").alias("name"), F.coalesce("status", F.lit("gap")).alias("what")).filter("what IN ('gap', 'thin')")
    said = F.array_compact(F.array(F.when((c("metadata") == 0) & (c("texts") > 0), "no metadata"), F.when((c("texts") > 0) & (c("embedded") / c("texts") < 0.8), "embedding gap")))
    return areas.unionByName(p.select(F.lit("source").alias("kind"), F.col("source_id").alias("name"), F.explode(said).alias("what")))


PROFILE = f"""{PASS}, {DEPTH_ROWS}, dp AS (SELECT source AS source_id, depth, lang FROM dd), hi AS (SELECT source_id, string_agg(depth || ':' || n, ',' ORDER BY depth) AS depths FROM (SELECT source_id, depth, count(*) AS n FROM dp GROUP BY ALL) GROUP BY 1),
tl AS (SELECT source_id, string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) AS langs FROM (SELECT source_id, lang, count(*) AS n FROM dp GROUP BY source_id, lang QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, lang) <= 3) GROUP BY 1)"""


@query(f"{PROFILE} SELECT source_id, round(texts / posts, 4) AS text_ratio, CASE WHEN texts > 0 THEN round(metadata / texts, 4) ELSE 0 END AS metadata_ratio, CASE WHEN texts > 0 THEN round(embedded / texts, 4) ELSE 0 END AS embedded_ratio, texts > 0 AND embedded / texts >= 0.8 AS ready, depths, langs FROM p JOIN hi USING (source_id) JOIN tl USING (source_id)")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, readiness, numbers of documents by depth and the three most frequent languages of each source."""
    c, d = F.col, T.docs(spark, sf_dir)
    depths = d.select("source_id", K.depth_label(c("text"), DEPTHS, news=NEWS).alias("name")).groupBy("source_id", "name").count()
    langs = R.top(d.groupBy("source_id", c("lang").alias("name")).count(), 3, [F.desc("count"), c("name")])
    listed = lambda df, out, key: df.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), "name", "count"))), lambda x: F.concat_ws(":", x["name"], x["count"])), ",").alias(out))
    of = passports(spark, sf_dir).join(listed(depths, "depths", c("name")), "source_id").join(listed(langs, "langs", c("rank")), "source_id")
    return of.select("source_id", K.ratio(c("texts"), c("posts")).alias("text_ratio"), K.ratio(c("metadata"), c("texts")).alias("metadata_ratio"), K.ratio(c("embedded"), c("texts")).alias("embedded_ratio"), ((c("texts") > 0) & (c("embedded") / c("texts") >= 0.8)).alias("ready"), "depths", "langs")


@query(f"WITH {D} SELECT source_id, doc_id FROM docs WHERE length(text) > 30 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, doc_id) <= 18")
def early_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the newest candidates, three times as many as representatives are wanted."""
    d = R.eligible(T.docs(spark, sf_dir)).select("source_id", "doc_id", "created_at")
    return R.top(d, 3 * 6, [F.desc("created_at"), F.col("doc_id")]).select("source_id", "doc_id")


@query()
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.representatives(written(labelled(spark, sf_dir).filter(F.size("labels") > 0), "labelled"))  # read twice, without the texts


@query("""WITH p AS (SELECT doc_id, source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY source) // 5) AS step FROM documents)
SELECT source_id, doc_id FROM p WHERE pos % step = 0 AND pos // step < 5""")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.spread(T.docs(spark, sf_dir).select("doc_id", "source_id"), 5, "source_id", [F.col("doc_id")], F.floor(F.col("doc_id") / IDS)).select("source_id", "doc_id")


@query("SELECT s.source_id, s.docs, coalesce(c.comments, 0) AS comments FROM (SELECT source AS source_id, count(*) AS docs FROM documents GROUP BY 1) s LEFT JOIN (SELECT source AS source_id, count(*) AS comments FROM conversations JOIN documents ON conv_id = doc_id GROUP BY 1) c USING (source_id)")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.docs(spark, sf_dir).select("doc_id", "source_id")
    comments = T.comments(spark, sf_dir).select("doc_id").join(d, "doc_id").groupBy("source_id").agg(F.count("*").alias("comments"))
    return d.groupBy("source_id").agg(F.count("*").alias("docs")).join(comments, "source_id", "left").fillna(0, ["comments"])


@query("SELECT source AS source_id, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM documents GROUP BY 1")
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).groupBy("source_id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))


@query("SELECT event_type AS state, count(*) AS n FROM events GROUP BY 1")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vec_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT conv_id) AS commented, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) - count(DISTINCT conv_id) AS remaining FROM conversations")
def distinct_commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.docs(spark, sf_dir).agg(F.count("*").alias("total"))
    c = T.comments(spark, sf_dir).agg(F.count_distinct("doc_id").alias("commented"))
    return c.crossJoin(n).withColumn("remaining", F.col("total") - F.col("commented"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM labels")
def cond_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""WITH r AS (SELECT l.doc_id, quality = 1 AS relevant, contains(lower(text), 'the') AS retrieved, length(text) >= 600 AS mapped FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l JOIN documents USING (doc_id))
SELECT count(*) FILTER (relevant AND retrieved AND mapped) AS found, count(*) FILTER (relevant AND NOT retrieved) AS lost_by_retrieval, count(*) FILTER (relevant AND retrieved AND NOT mapped) AS lost_by_map,
 count(*) FILTER (NOT relevant AND retrieved AND mapped) AS new_only, round(count(*) FILTER (relevant AND retrieved AND mapped) / count(*) FILTER (relevant), 6) AS recall FROM r""")
def relevant_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents that are relevant (by label), what a search for a word and then the model's relevance leave."""
    from ..operators.funnel import with_relevance

    l = T.raw(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    r = with_relevance(T.docs(spark, sf_dir)).join(l, "doc_id")
    rel, got, mapped = F.col("quality") == 1, F.contains(F.lower("text"), F.lit("the")), F.col("relevance") != "LOW"
    return r.agg(
        F.count_if(rel & got & mapped).alias("found"), F.count_if(rel & ~got).alias("lost_by_retrieval"), F.count_if(rel & got & ~mapped).alias("lost_by_map"),
        F.count_if(~rel & got & mapped).alias("new_only"), F.round(F.try_divide(F.count_if(rel & got & mapped), F.count_if(rel)), 6).alias("recall"),
    )


@query("WITH c AS (SELECT lang, source AS source_id, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT lang, source_id, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) <= 3")
def top_n_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.docs(spark, sf_dir).groupBy("lang", "source_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return R.top(c, 3, [F.desc("n"), F.col("first")], by="lang").select("lang", "source_id", "n")


@query("SELECT source AS source_id, count(*) AS docs, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / 4.0)::BIGINT AS tokens FROM documents GROUP BY 1")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.sum("n").cast("long")
    return T.docs(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("docs"), chars.alias("chars"), F.round(chars / 4).cast("long").alias("tokens"))


@query("SELECT event_type, round(avg((event_type <> 'error' AND value > 5)::INT), 6) AS success, round(avg(CASE WHEN value > 5 THEN value END), 6) AS latency FROM events GROUP BY 1")
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("event_type") != "error") & (F.col("value") > 5)
    return T.raw(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(ok.cast("int")), 6).alias("success"), F.round(F.avg(F.when(F.col("value") > 5, F.col("value"))), 6).alias("latency"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 4) AS mean FROM events")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return T.raw(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w) + 1e-9, 4).alias("mean"))


@query("SELECT user_id, coalesce(event_type, 'total') AS phase, date_diff('second', min(ts), max(ts)) AS seconds FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id), ())")
def phase_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last event of each user and phase, of each user in all, and of all users together (a null user)."""
    whole = lambda c: F.date_trunc("second", c).cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", whole(F.min("ts")), whole(F.max("ts")))
    return T.raw(spark, sf_dir, "events").rollup("user_id", "event_type").agg(seconds.alias("seconds")).select("user_id", F.coalesce("event_type", F.lit("total")).alias("phase"), "seconds")


@query("SELECT count(*) AS docs, max(length(text)) AS longest, count(DISTINCT source) AS sources FROM documents")
def total_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).agg(F.count("*").alias("docs"), F.max("n").cast("long").alias("longest"), F.count_distinct("source_id").alias("sources"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'click' AND value > 45) THEN 'active' WHEN bool_and(event_type <> 'error') THEN 'done' WHEN bool_or(event_type = 'error' AND value > 30) THEN 'error' ELSE 'pending' END AS state FROM events GROUP BY 1")
def phase_state_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    state = F.when(F.bool_or((t == "click") & (v > 45)), "active").when(F.bool_and(t != "error"), "done").when(F.bool_or((t == "error") & (v > 30)), "error").otherwise("pending")
    return T.raw(spark, sf_dir, "events").groupBy("user_id").agg(state.alias("state"))


@query("WITH p AS (SELECT doc_id, source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT 'P' || lpad(p.r::VARCHAR, 4, '0') || '.C' || lpad((row_number() OVER (PARTITION BY p.doc_id ORDER BY turn))::VARCHAR, 4, '0') AS ref, p.doc_id, turn FROM p JOIN conversations ON conv_id = p.doc_id QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY turn) <= 5")
def ordinal_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of documents in their source and of comments in their document, five of each at most."""
    d = numbered(T.docs(spark, sf_dir).select("doc_id", "source_id"), "source_id", [F.col("doc_id")], F.floor(F.col("doc_id") / IDS), "p").drop("source_id")
    c = T.comments(spark, sf_dir).select("doc_id", F.col("comment_id").alias("turn"), F.row_number().over(Window.partitionBy("doc_id").orderBy("comment_id")).alias("c")).filter("c <= 5")
    pad = lambda n: F.lpad(F.col(n).cast("string"), 4, "0")
    return d.join(c, "doc_id").select(F.concat(F.lit("P"), pad("p"), F.lit(".C"), pad("c")).alias("ref"), "doc_id", "turn")


@query("SELECT source AS source_id, coalesce(o.pos, 1000000)::INT AS pos FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (VALUES ('src3', 1), ('src1', 2)) o(s, pos) ON o.s = source")
def user_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.createDataFrame([("src3", 1), ("src1", 2)], "source_id string, pos int")
    return T.docs(spark, sf_dir).select("source_id").distinct().join(F.broadcast(o), "source_id", "left").select("source_id", F.coalesce("pos", F.lit(1_000_000)).alias("pos"))


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw(spark, sf_dir, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


@query(f"WITH {D} SELECT doc_id FROM docs ANTI JOIN (SELECT conv_id AS doc_id FROM conversations) USING (doc_id) ORDER BY created_at, doc_id LIMIT 1")
def next_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).join(T.comments(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").orderBy("created_at", "doc_id").limit(1).select("doc_id")


@query("SELECT text_md5, doc_id FROM (SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY 1)")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.min("doc_id").alias("doc_id"))
