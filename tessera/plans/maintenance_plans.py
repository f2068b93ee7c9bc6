"""Queries of sync, retention and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..operators import publishing as P
from ..operators.comments import latest
from ..sources import tables as T
from ..sources.shared import shared_path
from ..sources.store import Store
from .registry import query

D, L = T.DOCS_SQL, T.LINKS_SQL
CUT = "2025-01-01 00:00:00"
BUCKET = f"""WITH {D}, {L}, nw AS (SELECT doc_id FROM docs WHERE created_at >= TIMESTAMP '{CUT}'), ti AS (SELECT dst AS doc_id FROM links WHERE src IN (SELECT doc_id FROM nw) UNION SELECT src FROM links WHERE dst IN (SELECT doc_id FROM nw)),
bk AS (SELECT doc_id, source_id, created_at, CASE WHEN created_at >= TIMESTAMP '{CUT}' THEN 'new' WHEN doc_id IN (SELECT doc_id FROM ti) THEN 'linked' ELSE 'delete' END AS bucket FROM docs)"""


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prune_buckets(T.docs(spark, sf_dir).select("doc_id", "source_id", "created_at"), T.links(spark, sf_dir), CUT)


def stored(spark: SparkSession, sf_dir: str) -> Store:
    """The documents and what hangs on them as tables of a store of their own."""
    store = Store(spark, shared_path(spark, "store"))
    store.publish(
        replace={
            "documents": T.docs(spark, sf_dir).select("doc_id", "source_id", "created_at"), "comments": T.comments(spark, sf_dir).select("doc_id", "comment_id"), "links": T.links(spark, sf_dir),
            "labels": T.raw(spark, sf_dir, "labels").select("doc_id"), "vectors": T.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding"),
        }
    )
    return store


@query(f"{BUCKET} SELECT doc_id, bucket FROM bk")
def prune_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets(spark, sf_dir).select("doc_id", "bucket")


@query(f"{BUCKET} SELECT (SELECT count(*) FROM bk WHERE bucket = 'delete') AS docs, (SELECT count(*) FROM conversations WHERE conv_id IN (SELECT doc_id FROM bk WHERE bucket = 'delete')) AS comments, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM bk WHERE bucket = 'delete')) AS vectors")
def prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = buckets(spark, sf_dir).filter("bucket = 'delete'").select("doc_id")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    vectors = T.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"))
    return n(gone, "docs").crossJoin(n(T.comments(spark, sf_dir).join(gone, "doc_id", "left_semi"), "comments")).crossJoin(n(vectors.join(gone, "doc_id", "left_semi"), "vectors"))


@query(f"""{BUCKET}, gone AS (SELECT doc_id FROM bk WHERE bucket = 'delete') SELECT 'documents' AS name, doc_id, NULL::BIGINT AS other FROM bk WHERE bucket <> 'delete'
 UNION ALL SELECT 'comments', conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'links', src, dst FROM links WHERE src NOT IN (SELECT doc_id FROM gone) AND dst NOT IN (SELECT doc_id FROM gone)
 UNION ALL SELECT 'labels', doc_id, NULL FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'vectors', vec_id, NULL FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM gone)""")
def prune_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents and of all tables that hang on them, vectors too, when the old ones were taken out of all of them as one version."""
    store = stored(spark, sf_dir)
    P.prune(store, CUT)
    none, out = F.lit(None).cast("long"), None
    columns = {"documents": ("doc_id", none), "comments": ("doc_id", F.col("comment_id")), "links": ("src", F.col("dst")), "labels": ("doc_id", none), "vectors": ("doc_id", none)}
    for name, (key, other) in columns.items():
        one = store.read(name).select(F.lit(name).alias("name"), F.col(key).alias("doc_id"), other.alias("other"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{BUCKET}, old AS (SELECT doc_id, source_id, created_at FROM bk WHERE created_at < TIMESTAMP '{CUT}'), cc AS (SELECT source_id, count(*) AS comments FROM conversations JOIN old ON conv_id = doc_id GROUP BY 1), ll AS (SELECT source_id, count(*) AS n_links FROM links JOIN old ON src = doc_id GROUP BY 1)
SELECT source_id, count(*) AS n, strftime(min(created_at), '%Y-%m-%d') AS first, strftime(max(created_at), '%Y-%m-%d') AS last, coalesce(max(comments), 0) AS comments, coalesce(max(n_links), 0) AS links FROM old LEFT JOIN cc USING (source_id) LEFT JOIN ll USING (source_id) GROUP BY 1""")
def prune_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    old = T.docs(spark, sf_dir).filter(F.col("created_at") < F.lit(CUT).cast("timestamp_ntz")).select("doc_id", "source_id", "created_at")
    of = lambda rows, name: rows.join(old, "doc_id").groupBy("source_id").agg(F.count("*").alias(name))
    comments = of(T.comments(spark, sf_dir).select("doc_id"), "comments")
    links = of(T.links(spark, sf_dir).select(F.col("src").alias("doc_id")), "links")
    by = old.groupBy("source_id").agg(F.count("*").alias("n"), day(F.min("created_at")).alias("first"), day(F.max("created_at")).alias("last"))
    return by.join(comments, "source_id", "left").join(links, "source_id", "left").fillna(0, ["comments", "links"])


@query(f"""WITH {L}, t AS (SELECT doc_id FROM labels) SELECT 'vectors' AS name, vec_id AS key FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM t) UNION ALL SELECT 'comments', conv_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM t)
 UNION ALL SELECT 'documents', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t) UNION ALL SELECT 'link source', src FROM links WHERE src NOT IN (SELECT doc_id FROM t) UNION ALL SELECT 'link target', dst FROM links WHERE dst NOT IN (SELECT doc_id FROM t)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three tables and either end of links that no row of the labels stands for."""
    links, labels = T.links(spark, sf_dir), T.raw(spark, sf_dir, "labels").select("doc_id")
    children = {
        "vectors": T.vectors(spark, sf_dir).select(F.col("vec_id").alias("key")), "comments": T.comments(spark, sf_dir).select(F.col("doc_id").alias("key")), "documents": T.raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")),
        "link source": links.select(F.col("src").alias("key")), "link target": links.select(F.col("dst").alias("key")),
    }
    out = None
    for name, child in children.items():
        one = M.orphans(child, "key", labels, "doc_id").select(F.lit(name).alias("name"), "key")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{BUCKET} SELECT source_id, count(*) AS before, count(*) FILTER (bucket <> 'delete') AS after, count(*) FILTER (bucket = 'delete') AS removed FROM bk GROUP BY 1 HAVING removed > 0")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = buckets(spark, sf_dir)
    return M.diff_counts(b, b.filter("bucket <> 'delete'"), "source_id")


@query("SELECT conv_id AS doc_id, role AS author, arg_max(turn, turn) AS comment_id FROM conversations GROUP BY ALL")
def comment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comment per document and author, the last one."""
    c = T.comments(spark, sf_dir).select("doc_id", F.col("role").alias("author"), "comment_id")
    return latest(c, ["doc_id", "author"], [F.desc("comment_id")])


CANDIDATES = """c AS (SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'nation_1' ELSE lower(replace(n_name, ' ', '_')) END AS source_id, 'ch' || CASE n_nationkey WHEN 8 THEN 7 ELSE n_nationkey END AS channel FROM nation WHERE n_nationkey < 10)"""


@query(f"""WITH {CANDIDATES}, o AS (SELECT c_nationkey AS k, count(*) AS n, max(c_custkey) AS mark FROM customer GROUP BY 1),
v AS (SELECT c.*, n, mark, CASE WHEN NOT regexp_full_match(source_id, '[a-z0-9_]+') THEN 'bad id' WHEN k = 6 THEN 'exists' WHEN k = 8 THEN 'exists' WHEN k = 4 THEN 'failed' ELSE 'added' END AS verdict FROM c JOIN o USING (k))
SELECT source_id, k, verdict, CASE verdict WHEN 'added' THEN n ELSE 0 END AS documents, CASE verdict WHEN 'added' THEN mark ELSE 0 END AS mark, (SELECT sum(n) FROM v WHERE verdict = 'added')::BIGINT AS stored FROM v""")
def add_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nations are to be sources, with their customers for documents: some have no fit id, an id or a channel that is taken, or an import that breaks off. What became of each, and how many documents are stored after all."""
    store, rows = Store(spark, shared_path(spark, "sources")), []
    customers = T.raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey", F.col("c_name").alias("text"))
    nations = T.raw(spark, sf_dir, "nation").filter("n_nationkey < 10").select("n_nationkey", "n_name").orderBy("n_nationkey").toLocalIterator()
    for k, name in nations:
        source_id = {0: name, 1: "nation_1"}.get(k % 5, name.lower().replace(" ", "_"))

        def imported(k: int = k) -> DataFrame:
            own = customers.filter(F.col("c_nationkey") == k).drop("c_nationkey")
            return own.withColumn("text", F.raise_error(F.lit("the file is broken"))) if k == 4 else own

        try:
            got, verdict = P.add_source(store, source_id, name, f"ch{7 if k == 8 else k}", imported), "added"
        except P.Refused as e:
            got, verdict = {}, "bad id" if "is no id" in str(e) else "exists"
        except Exception:
            got, verdict = {}, "failed"
        rows.append((source_id, k, verdict, got.get("documents", 0), got.get("mark", 0)))
    out = spark.createDataFrame(rows, "source_id string, k long, verdict string, documents long, mark long")
    return out.crossJoin(store.read("documents").agg(F.count("*").alias("stored")))


@query("""WITH c AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE lower(n_name) END AS source_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS n_docs FROM nation UNION ALL SELECT DISTINCT source, 1 FROM documents)
SELECT source_id, CASE WHEN source_id IS NULL OR NOT regexp_full_match(source_id, '[a-z0-9_]+') THEN 'bad id' WHEN source_id IN (SELECT source FROM documents) THEN 'exists' WHEN n_docs = 0 THEN 'empty' ELSE 'added' END AS verdict FROM c""")
def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would become of candidates (nations, by their customers of high balance, and the sources themselves): only new ones with a fit id and documents can be added."""
    known = T.docs(spark, sf_dir).select("source_id").distinct()
    n = T.raw(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n_docs"))
    key = F.col("n_nationkey")
    nations = T.raw(spark, sf_dir, "nation").join(n, key == F.col("c_nationkey"), "left")
    candidates = nations.select(F.when(key % 3 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("source_id"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    return M.admitted(candidates.unionByName(known.withColumn("n_docs", F.lit(1).cast("long"))), known)


@query("SELECT doc_id, min(priority)::INT AS priority FROM (SELECT doc_id, 0 AS priority FROM labels WHERE toxic = 1 UNION ALL SELECT conv_id, 1 FROM conversations UNION ALL SELECT vec_id, 2 FROM embeddings) GROUP BY 1")
def topics_dedupe_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists one after another, each key from the first list that has it."""
    parts = [T.raw(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), T.comments(spark, sf_dir).select("doc_id"), T.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"))]
    return M.prioritised(parts, "doc_id").select("doc_id", "priority")
