"""Queries of the relevance funnel, links and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import funnel as P
from ..operators import maintenance as M
from ..operators.numbering import numbered
from ..sources import tables as T
from .registry import query

D, L = T.DOCS_SQL, T.LINKS_SQL
REL = "rel AS (SELECT *, CASE WHEN n >= 2400 THEN 'HIGH' WHEN n >= 600 THEN 'MEDIUM' ELSE 'LOW' END AS relevance FROM docs)"
RANK = "CASE relevance WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 WHEN 'CONTEXT' THEN 3 ELSE 4 END"
B = f"WITH {D}, {REL}"


def rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_relevance(T.docs(spark, sf_dir))


@query(f"WITH {D} SELECT source_id, doc_id, ((row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, doc_id) - 1) // 50)::BIGINT AS chunk FROM docs")
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunks(T.docs(spark, sf_dir)).select("source_id", "doc_id", "chunk")


@query(f"""{B}, p AS (SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, doc_id) - 1) // 50 AS chunk FROM rel), c AS (SELECT source_id, chunk, bool_or(doc_id % 97 = 5) AS bad FROM p GROUP BY ALL)
SELECT doc_id, CASE WHEN NOT bad THEN relevance END AS relevance, CASE WHEN NOT bad THEN 'length ' || n END AS reason, CASE WHEN bad THEN 'refused' END AS error FROM p JOIN c USING (source_id, chunk)""")
def map_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a source's documents, each by one call of a model that fails at some of them once and refuses others for good."""
    failed: set[int] = set()

    def scorer(chunk):
        first = int(chunk["doc_id"].min())
        if first % 3 == 0 and first not in failed:
            failed.add(first)
            raise RuntimeError("busy")
        if (chunk["doc_id"] % 97 == 5).any():
            raise RuntimeError("refused")
        return P.threshold_scorer(chunk)

    docs = P.chunks(T.docs(spark, sf_dir)).select("source_id", "chunk", "doc_id", "text")
    return P.map_scores(docs, scorer, cooldown=0.1, by=["source_id", "chunk"])


@query(f"{B} SELECT source_id, doc_id, relevance, row_number() OVER (PARTITION BY source_id ORDER BY {RANK}, doc_id) AS place FROM rel")
def map_merge_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ranked_by_relevance(rel(spark, sf_dir)).select("source_id", "doc_id", "relevance", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10.0::DOUBLE ELSE 0.0 END AS score, CASE WHEN doc_id % 3 = 0 THEN 'because ' || doc_id ELSE '' END AS reason FROM documents")
def parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.docs(spark, sf_dir).select("doc_id")
    block = F.concat(F.lit("=== POST 1 ===\nID: "), "doc_id", F.lit("\nScore: "), (F.col("doc_id") % 10 / 10).cast("string"), F.lit("\nReason: because "), "doc_id", F.lit("\n=== POST 2 ===\nID: 99999999\nScore: 1.0\nReason: unknown\n"))
    return P.parsed_scores(docs.filter("doc_id % 3 = 0").select(block.alias("answer")), docs)


@query(f"""{B}, m AS (SELECT source_id, doc_id, (n % 100) / 100.0 AS score, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS pos FROM rel WHERE relevance = 'MEDIUM')
SELECT source_id, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, pos) AS rank FROM m WHERE pos <= 50 AND score >= 0.7 QUALIFY rank <= 5""")
def medium_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best_medium(rel(spark, sf_dir).withColumn("score", F.col("n") % 100 / 100)).select("source_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"{B} SELECT source_id, count(*) FILTER (relevance = 'HIGH') AS high, count(*) FILTER (relevance = 'MEDIUM') AS medium, count(*) FILTER (relevance = 'LOW') AS low, count(*) FILTER (relevance = 'CONTEXT') AS context FROM rel GROUP BY source_id")
def relevance_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda r: F.count_if(F.col("relevance") == r).alias(r.lower())
    return rel(spark, sf_dir).groupBy("source_id").agg(*map(of, P.RELEVANCE))


@query(f"{B} SELECT doc_id, relevance FROM rel WHERE relevance IN ('HIGH', 'MEDIUM')")
def split_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir).filter(F.col("relevance").isin("HIGH", "MEDIUM")).select("doc_id", "relevance")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1")
def enrich_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = T.raw(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", "quality")
    return T.raw(spark, sf_dir, "documents").select("doc_id", "lang").join(scored, "doc_id")


SEEDS = f"{B}, {L}, seeds AS (SELECT doc_id AS seed, source_id AS of FROM rel WHERE relevance = 'HIGH')"
NBR = """nb AS (SELECT d.doc_id, d.source_id, s.seed FROM (SELECT src AS a, dst AS b FROM links UNION ALL SELECT dst, src FROM links) k JOIN seeds s ON k.a = s.seed JOIN docs d ON d.doc_id = k.b
 WHERE d.source_id = s.of AND d.doc_id NOT IN (SELECT seed FROM seeds) AND d.created_at >= TIMESTAMP '2024-06-01')"""


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = rel(spark, sf_dir).filter("relevance = 'HIGH'").select("doc_id", "source_id")
    return P.neighbours(seeds, T.links(spark, sf_dir), T.docs(spark, sf_dir), "2024-06-01 00:00:00")


@query(f"{SEEDS}, {NBR} SELECT DISTINCT source_id, doc_id FROM nb")
def link_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(spark, sf_dir).select("source_id", "doc_id")


@query(f"{SEEDS}, {NBR} SELECT doc_id, string_agg(DISTINCT seed, ',' ORDER BY seed) AS parents, CASE WHEN count(DISTINCT seed) = 1 THEN min(seed) END AS parent FROM nb GROUP BY doc_id")
def link_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(spark, sf_dir).select("doc_id", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"), "parent")


@query(f"{B} SELECT doc_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, {RANK}, doc_id) AS place FROM rel")
def sort_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("created_at"), P.relevance_rank(), F.col("doc_id")]
    return numbered(rel(spark, sf_dir), "source_id", order, -F.unix_date(F.col("created_at").cast("date")), "place").select("doc_id", "source_id", F.col("place").cast("long").alias("place"))


@query(f"{B} SELECT source_id, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY {RANK}, created_at DESC, doc_id) AS place FROM rel QUALIFY place <= 50")
def context_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.limited(rel(spark, sf_dir)).select("source_id", "doc_id", F.col("place").cast("long").alias("place"))


@query(f"{B} SELECT source_id, doc_id FROM rel WHERE relevance = 'HIGH' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, doc_id) <= 5")
def default_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.limited(rel(spark, sf_dir).filter("relevance = 'HIGH'"), 5).select("source_id", "doc_id")


ANS = "ans AS (SELECT doc_id AS answer_id, 'See [post:' || doc_id || '] and [post:' || (doc_id * 7 + 1) || '], not [post: 1], again [post:' || doc_id || '].' AS answer FROM documents)"
CITED = f"{ANS}, cit AS (SELECT answer_id, unnest(regexp_extract_all(answer, '\\[post:([0-9]+)\\]', 1))::BIGINT AS doc_id FROM ans)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("See [post:"), "doc_id", F.lit("] and [post:"), F.col("doc_id") * 7 + 1, F.lit("], not [post: 1], again [post:"), "doc_id", F.lit("]."))
    return T.docs(spark, sf_dir).select(F.col("doc_id").alias("answer_id"), text.alias("answer"))


@query(f"WITH {CITED} SELECT answer_id, doc_id FROM cit")
def cite_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.citations(answers(spark, sf_dir)).select("answer_id", "doc_id")


@query(f"WITH {CITED} SELECT answer_id, count(*) AS refs, count(d.doc_id) AS valid, round(count(d.doc_id) / count(*), 6) AS accuracy FROM cit LEFT JOIN documents d USING (doc_id) GROUP BY answer_id")
def cite_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.accuracy(P.citations(answers(spark, sf_dir)), T.docs(spark, sf_dir))
    return found.select("answer_id", "refs", "valid", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT doc_id AS answer_id, CASE WHEN doc_id = 0 THEN '0,1,2' ELSE array_to_string(list_sort(list_distinct([0, 1, 2, doc_id, doc_id * 7 + 1])), ',') END AS sources FROM documents")
def cite_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = P.citations(answers(spark, sf_dir)).groupBy("answer_id").agg(F.collect_set("doc_id").alias("cited"))
    main = F.array(*(F.lit(i).cast("long") for i in (0, 1, 2)))
    return cited.select("answer_id", F.array_join(P.reconciled(main, F.col("cited")).cast("array<string>"), ",").alias("sources"))


@query(f"WITH {CITED} SELECT answer_id, count(DISTINCT c.doc_id) FILTER (d.doc_id IS NOT NULL) AS valid, count(DISTINCT c.doc_id) FILTER (d.doc_id IS NULL) AS invalid FROM cit c LEFT JOIN documents d ON d.doc_id = c.doc_id GROUP BY answer_id")
def cite_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = P.citations(answers(spark, sf_dir)).select("answer_id", "doc_id").distinct()
    known = T.docs(spark, sf_dir).select("doc_id", F.lit(True).alias("known"))
    joined = cited.join(known, "doc_id", "left")
    return joined.groupBy("answer_id").agg(F.count_if(F.col("known").isNotNull()).alias("valid"), F.count_if(F.col("known").isNull()).alias("invalid"))


@query(f"WITH {D} SELECT source_id, strftime(min(created_at), '%Y-%m-%d') AS first, strftime(max(created_at), '%Y-%m-%d') AS last, count(DISTINCT strftime(created_at, '%Y-%m')) AS months, count(*) AS docs FROM docs GROUP BY 1")
def date_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return T.docs(spark, sf_dir).groupBy("source_id").agg(day(F.min("created_at")).alias("first"), day(F.max("created_at")).alias("last"), F.count_distinct(F.date_format("created_at", "yyyy-MM")).alias("months"), F.count("*").alias("docs"))


#: What is claimed of a source's period.
CLAIM = "CASE CAST(substr(source_id, 4) AS INT) % 6 WHEN 0 THEN 'Последние 23 месяца' WHEN 1 THEN concat('за последний ', substr(source_id, 4), ' месяц, 2 года') WHEN 2 THEN 'с Сентября' WHEN 3 THEN 'август и июль' WHEN 4 THEN 'в июле' ELSE 'недавно' END"


@query(f"""WITH {D}, s AS (SELECT source_id, min(created_at) AS a, max(created_at) AS b FROM docs GROUP BY 1), c AS (SELECT *, lower({CLAIM}) AS q, (year(b) - year(a)) * 12 + month(b) - month(a) + 1 AS months FROM s)
SELECT source_id, CASE WHEN contains(q, 'сентябр') THEN month(a) = 9 OR month(b) = 9 WHEN contains(q, 'август') THEN month(a) = 8 OR month(b) = 8 WHEN contains(q, 'июл') THEN month(a) = 7 OR month(b) = 7
 WHEN contains(q, 'последн') AND contains(q, 'месяц') AND regexp_matches(q, '[0-9]') THEN abs(months - regexp_extract(q, '[0-9]+')::INT) <= 1 ELSE true END AS holds FROM c""")
def period_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what is claimed of each source's period holds for its documents."""
    spans = T.docs(spark, sf_dir).groupBy("source_id").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    return spans.select("source_id", P.period_holds(F.expr(CLAIM), F.col("first"), F.col("last")).alias("holds"))


WORDS = "list_distinct(string_split_regex(lower({0}), '[ \\t\\n\\r\\f\\v]+'))"
PAIRS = "SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 2"


@query(f"WITH p AS ({PAIRS}) SELECT item_id, contains(lower(x), lower(y)) OR contains(lower(y), lower(x)) OR len(list_intersect({WORDS.format('x')}, {WORDS.format('y')})) / len(list_distinct(list_concat({WORDS.format('x')}, {WORDS.format('y')}))) >= 0.8 AS same FROM p")
def jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.raw(spark, sf_dir, "benchmark")
    pairs = b.select("item_id", F.col("text").alias("x"), (F.col("item_id") - F.col("item_id") % 2).alias("o")).join(b.select(F.col("item_id").alias("o"), F.col("text").alias("y")), "o")
    return pairs.select("item_id", P.same_fact(F.col("x"), F.col("y")).alias("same"))


@query("SELECT doc_id, concat_ws(E'\\n\\n', 'Quality: ' || quality, CASE WHEN toxic = 1 THEN 'Toxic' END) AS text FROM labels")
def sections_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = T.raw(spark, sf_dir, "labels")
    return lab.select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("Quality: "), "quality"), F.when(F.col("toxic") == 1, "Toxic")).alias("text"))


@query("SELECT lang, count(DISTINCT source) >= 2 AS synthesize FROM documents GROUP BY lang")
def meta_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).groupBy("lang").agg((F.count_distinct("source_id") >= 2).alias("synthesize"))


# Joins.


@query("SELECT c.conv_id AS doc_id, c.turn AS comment_id, d.source AS source_id FROM conversations c JOIN documents d ON c.conv_id = d.doc_id")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.comments(spark, sf_dir).select("doc_id", "comment_id").join(T.docs(spark, sf_dir).select("doc_id", "source_id"), "doc_id")


@query("SELECT d.source AS source_id, count(*) AS n FROM conversations c JOIN documents d ON c.conv_id = d.doc_id JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def join_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_inner(spark, sf_dir).join(T.raw(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("source_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.quality = 0")
def join_left_or_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = T.raw(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there"), "quality")
    joined = T.docs(spark, sf_dir).select("doc_id").join(lab, "doc_id", "left")
    return joined.filter(F.col("there").isNull() | (F.col("quality") == 0)).select("doc_id").distinct()


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.doc_id)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).select("doc_id").join(T.comments(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).select("doc_id").join(T.comments(spark, sf_dir).select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {L}, s AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT src, dst FROM links WHERE src IN (SELECT doc_id FROM s) OR dst IN (SELECT doc_id FROM s)")
def join_either_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with either end in a set: two semi-joins united."""
    s, k = T.raw(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), T.links(spark, sf_dir).select("src", "dst")
    return k.join(s, k.src == s.doc_id, "left_semi").unionByName(k.join(s, k.dst == s.doc_id, "left_semi")).distinct()


@query("SELECT coalesce(a.source, b.source) AS source_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) b ON a.source = b.source")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.docs(spark, sf_dir).select("doc_id", "source_id")
    a, b = (d.filter(f"doc_id % {k} = 0").groupBy("source_id").agg(F.count("*").alias(n)) for k, n in ((2, "before"), (3, "after")))
    return a.join(b, "source_id", "full").select("source_id", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


@query("SELECT a.conv_id AS doc_id, a.turn AS comment_id, b.role AS parent_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def join_reply_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.comments(spark, sf_dir)
    parents = c.select("doc_id", (F.col("comment_id") + 1).alias("comment_id"), F.col("role").alias("parent_role"))
    return c.select("doc_id", "comment_id").join(parents, ["doc_id", "comment_id"])


@query("SELECT i, count(*) AS n FROM (SELECT unnest([lang, source]) AS i FROM documents) GROUP BY i HAVING i IN ('en', 'src1')")
def join_array_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("en",), ("src1",)], "i string")
    rows = T.docs(spark, sf_dir).select(F.explode(F.array("lang", "source_id")).alias("i"))
    return rows.join(F.broadcast(wanted), "i").groupBy("i").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE m AS (SELECT conv_id || '/' || turn AS id, CASE WHEN turn > 0 THEN conv_id || '/' || (turn - 1) END AS parent, role <> 'user' AS is_text FROM conversations),
w AS (SELECT id, id AS cur FROM m UNION ALL SELECT w.id, m.parent FROM w JOIN m ON m.id = w.cur WHERE m.parent IN (SELECT id FROM m)),
e AS (SELECT w.id, w.cur FROM w JOIN m ON m.id = w.cur WHERE m.parent IS NULL AND m.is_text)
SELECT id, coalesce(cur, id) AS root FROM m LEFT JOIN e USING (id)""")
def reply_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda turn: F.concat_ws("/", "conv_id", turn)
    turn = F.col("turn")
    return M.roots(T.raw(spark, sf_dir, "conversations").select(key(turn).alias("id"), F.when(turn > 0, key(turn - 1)).alias("parent"), (F.col("role") != "user").alias("is_text")))
