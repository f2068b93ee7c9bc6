"""Queries of comments, thread topics, evidence and community ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.model_json import model_json
from ..operators import answers as A
from ..operators import comments as C
from ..operators import community as Q
from ..operators import evidence as V
from ..operators import funnel as P
from ..operators import video as H
from ..operators.retrieval import top
from ..sources import exports as E
from ..sources import tables as T
from ..sources.shared import shared_path, written
from ..streaming import jobs
from ..streaming import queue as W
from .registry import query

D, CM = T.DOCS_SQL, T.COMMENTS_SQL


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = T.docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("channel"), F.col("doc_id") % 7)).alias("post_author"))
    c = T.comments(spark, sf_dir).select("doc_id", "comment_id", F.when(F.col("kind") != "other", (F.col("comment_id") % 7).cast("string")).alias("author_id"))
    return C.by_author(c, posts)


SIDED = """s AS (SELECT c.conv_id AS doc_id, turn AS comment_id, CASE WHEN role <> 'system' THEN (turn % 7)::VARCHAR END AS a, CASE WHEN d.doc_id % 5 <> 0 THEN (d.doc_id % 7)::VARCHAR END AS own
 FROM conversations c JOIN documents d ON d.doc_id = c.conv_id)"""


@query(f"WITH {SIDED} SELECT doc_id, comment_id FROM s WHERE a = own")
def comments_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sided(spark, sf_dir).filter("side = 'author'").select("doc_id", "comment_id")


@query(f"WITH {SIDED} SELECT doc_id, comment_id FROM s WHERE own IS NULL OR a <> own")
def comments_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sided(spark, sf_dir).filter("side = 'community'").select("doc_id", "comment_id")


@query(f"WITH {CM} SELECT doc_id, count(*) FILTER (kind = 'author') AS author, count(*) FILTER (kind = 'community') AS community, count(*) FILTER (kind = 'other') AS other FROM comments WHERE trim(comment_text) <> '' GROUP BY doc_id")
def comments_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return T.comments(spark, sf_dir).filter(F.trim("comment_text") != "").groupBy("doc_id").agg(*map(of, ("author", "community", "other")))


@query(f"WITH {CM} SELECT doc_id, comment_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'author' THEN 0 WHEN 'community' THEN 1 ELSE 2 END, comment_id) AS place FROM comments QUALIFY place <= 3")
def comment_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.capped(T.comments(spark, sf_dir), 3).select("doc_id", "comment_id", F.col("place").cast("long").alias("place"))


def topic_json():
    n = F.col("vec_id")
    one = F.concat(F.lit('{"topic":"t'), n, F.lit('","keywords":["k1","k2"],"key_phrases":["p '), n, F.lit('"],"context":"c"}'))
    return F.when(n % 4 == 0, F.concat(F.lit("["), one, F.lit("]"))).when(n % 4 == 1, F.concat(F.lit('{"drift_topics":['), one, F.lit("]}"))).when(n % 4 == 2, F.concat(F.lit('{"drift_topics":{"drift_topics":['), one, F.lit("]}}"))).otherwise(F.lit("broken"))


ONE = """'{"topic":"' || word || '","keywords":["k1"],"key_phrases":["p ' || doc_id || '"],"context":"c"}'"""
GROUPS = f"""g0 AS (SELECT doc_id, source AS source_id, doc_id % 3 <> 0 AS drifted, regexp_extract(text, '[a-z]+') AS word, doc_id % 5 < 4 AS has, doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) AS embedded FROM documents), g AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN '[' || {ONE} || ']'
 WHEN 3 THEN '{{drift_topics:[{{topic:"' || word || '"}}]}}' WHEN 4 THEN 'broken {{' ELSE '{{"drift_topics":[' || {ONE} || ']}}' END AS topics FROM g0)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of comments by document: whether they drifted, topics (the first word of the text) in four layouts of JSON or broken, and vectors of some."""
    n, word = F.col("doc_id"), F.regexp_extract("text", "[a-z]+", 0)
    one = F.concat(F.lit('{"topic":"'), word, F.lit('","keywords":["k1"],"key_phrases":["p '), n, F.lit('"],"context":"c"}'))
    wrapped = lambda a, b: F.concat(F.lit(a), one, F.lit(b))
    topics = (
        F.when(n % 5 == 0, wrapped("[", "]")).when(n % 5 == 1, wrapped('{"drift_topics":[', "]}")).when(n % 5 == 2, wrapped('{"drift_topics":{"drift_topics":[', "]}}"))
        .when(n % 5 == 3, F.concat(F.lit('{drift_topics:[{topic:"'), word, F.lit('"}]}'))).otherwise("broken {")
    )
    vectors = T.vectors(spark, sf_dir).filter("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    return T.docs(spark, sf_dir).select("doc_id", "source_id", (n % 3 != 0).alias("drifted"), topics.alias("topics")).join(vectors, "doc_id", "left")


@query(f"""WITH {D}, {GROUPS} SELECT g.doc_id, has::INT AS n_topics, CASE WHEN has THEN word END AS topic, coalesce(c.n, 0) AS n_comments FROM g JOIN docs ON docs.doc_id = g.doc_id LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON conv_id = g.doc_id
 WHERE drifted AND created_at >= TIMESTAMP '2024-07-01' AND g.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def topics_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that drifted from posts since July 2024 that aren't excluded (here as toxic), with their topics and the number of their comments."""
    out = C.thread_groups(groups(spark, sf_dir), T.docs(spark, sf_dir), T.comments(spark, sf_dir), "2024-07-01 00:00:00", T.raw(spark, sf_dir, "labels").filter("toxic = 1"))
    return out.select("doc_id", F.size("topics").alias("n_topics"), F.get("topics", F.lit(0)).getField("topic").alias("topic"), "n_comments")


@query(f"WITH {GROUPS} SELECT doc_id, doc_id % 5 = 2 AS fixed, topics FROM g")
def topics_unnest_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups, those whose topics were nested twice rewritten with one level."""
    made = C.unnested(F.col("topics"))
    return groups(spark, sf_dir).select("doc_id", (made != F.col("topics")).alias("fixed"), made.alias("topics"))


@query("SELECT vec_id, 't' || vec_id || ' k1 k2 p ' || vec_id || ' c' AS text FROM embeddings WHERE vec_id % 4 < 3")
def topic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.vectors(spark, sf_dir).select("vec_id", F.explode(C.parsed_topics(topic_json())).alias("t"))
    return rows.select("vec_id", C.topic_text(F.col("t")).alias("text"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: v.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"


@query(f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 7), s AS (SELECT v.vec_id, label, {DOT} AS similarity FROM embeddings v, q)
SELECT label, vec_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 20 AND similarity >= 0.1""")
def topic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .retrieval_plans import target

    groups = T.vectors(spark, sf_dir).select(F.col("vec_id").alias("group_id"), F.col("label").alias("source_id"), "embedding")
    found = C.similar_topics(groups, target(spark, sf_dir), 20, 0.1)
    return found.select(F.col("source_id").alias("label"), F.col("group_id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


HITS = X.n_sql("'t' || vec_id || ' k1 k2 p ' || vec_id || ' c'", ["p 1", "t2"])


@query(f"""WITH q AS (SELECT embedding AS target FROM embeddings WHERE vec_id = 7), w AS (SELECT label, bool_and(label % 2 = 0 OR vec_id % 5 <> 3) AS whole FROM embeddings GROUP BY 1), s AS (SELECT label, vec_id, whole, {DOT.replace("q.embedding", "target")} AS similarity FROM embeddings v JOIN w USING (label), q)
SELECT label, vec_id, 'vectors' AS path, round(similarity, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS r FROM s WHERE whole) WHERE r <= 20 AND similarity >= 0.1
UNION ALL SELECT label, vec_id, 'texts', {HITS}::DOUBLE FROM s WHERE NOT whole AND vec_id % 4 < 3 AND {HITS} > 0""")
def topic_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by their vectors where all groups of a source have one; where one lacks it (here some of odd labels), by words of their topics."""
    from .retrieval_plans import target

    n = F.col("vec_id")
    vector = F.when((F.col("label") % 2 == 0) | (n % 5 != 3), F.col("embedding"))
    text = F.coalesce(C.topic_text(F.get(C.parsed_topics(topic_json()), F.lit(0))), F.lit(""))
    rows = T.vectors(spark, sf_dir).select(n.alias("group_id"), F.col("label").alias("source_id"), vector.alias("embedding"), text.alias("text"))
    found = C.dispatched(rows, target(spark, sf_dir), lambda t: X.n_of(t, ["p 1", "t2"]), 20, 0.1)
    return found.select(F.col("source_id").alias("label"), F.col("group_id").alias("vec_id"), "path", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(CASE WHEN vec_id % 9 = 0 THEN NULL ELSE 1.0 END, 6) AS norm2 FROM embeddings")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x * (F.col("vec_id") % 9)).alias("e"))
    return v.select("vec_id", F.round(C.dot(C.normalised(F.col("e")), C.normalised(F.col("e"))), 6).alias("norm2"))


@query(f"WITH {GROUPS} SELECT doc_id, 16::INT AS places, 1.0::DOUBLE AS norm FROM g WHERE drifted AND has AND (doc_id % 5 <> 3 OR word <> '') AND NOT embedded ORDER BY doc_id LIMIT 50")
def topics_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the next batch of groups that drifted and have topics but no vector, in order of the id."""
    from ..operators.retrieval import hashed_embedding

    v = F.col("embedding")
    return C.backfilled(groups(spark, sf_dir), 50, hashed_embedding).select("doc_id", F.size(v).alias("places"), F.round(C.dot(v, v), 6).alias("norm"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'fixed' WHEN 2 THEN 'fixed' ELSE 'unrecoverable' END AS state,
 CASE event_id % 4 WHEN 3 THEN NULL ELSE regexp_replace(props, '[^0-9]', '', 'g')::BIGINT END AS k FROM events""")
def json_repair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as they are, with bare keys, in a code fence, and cut off."""
    e, n = T.raw(spark, sf_dir, "events").select("event_id", "props"), F.col("event_id") % 4
    text = F.when(n == 0, F.col("props")).when(n == 1, F.regexp_replace("props", '"k"', "k")).when(n == 2, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.regexp_replace("props", "[}]", ""))
    fixed = C.repaired_json(text)
    return e.select("event_id", F.when(fixed.isNull(), "unrecoverable").when(fixed == text, "valid").otherwise("fixed").alias("state"), F.get_json_object(fixed, "$.k").cast("long").alias("k"))


#: When a group was put into the queue (some twice), how many attempts of its work fail, and the end of the stream.
QUEUED = "SELECT doc_id, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 37 % 5000) AS t0, doc_id % 5 AS fails FROM documents"


@query(f"""WITH q AS ({QUEUED}), has AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), a AS (SELECT q.*, has.doc_id IS NOT NULL AS has FROM q LEFT JOIN has USING (doc_id)), w AS (SELECT max(t0) AS wm FROM a),
e AS (SELECT doc_id, t0, has, fails FROM a UNION ALL SELECT doc_id, t0 + INTERVAL 90 SECOND, has, fails FROM a WHERE doc_id % 4 = 0 AND t0 + INTERVAL 90 SECOND <= (SELECT wm FROM w)),
n AS (SELECT *, lead(t0) OVER (PARTITION BY doc_id ORDER BY t0) AS nxt FROM e),
t AS (SELECT doc_id, t0, nxt, has, fails, unnest([0, 60, 180]) AS after, unnest([1, 2, 3]) AS attempt FROM n WHERE has),
s AS (SELECT doc_id, t0 + to_seconds(after) AS t0, attempt AS attempts, CASE WHEN attempt > fails THEN 'checked' WHEN attempt = 3 THEN 'error' ELSE 'pending' END AS state FROM t, w WHERE attempt <= fails + 1 AND t0 + to_seconds(after) <= wm AND (nxt IS NULL OR after = 0 OR t0 + to_seconds(after) <= nxt)
 UNION ALL SELECT doc_id, t0, 0, 'no-comments' FROM n WHERE NOT has)
SELECT doc_id, state, attempts FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t0 DESC, attempts) = 1""")
def topic_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has become of each group by the end of the stream: checked, without comments, waiting for another attempt, or given up after three."""
    folder, late = shared_path(spark, "queue"), F.col("doc_id") % 4 == 0
    has = T.comments(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_comments"))
    d = T.raw(spark, sf_dir, "documents").select("doc_id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 37 % 5000).alias("at"), (F.col("doc_id") % 5).cast("string").alias("payload"))
    events = d.join(has, "doc_id", "left").select(F.col("doc_id").alias("group_id"), "at", F.coalesce("n_comments", F.lit(0)).alias("n_comments"), "payload", late.alias("late"))
    last = events.agg(F.max("at").alias("last"))
    again = events.filter("late").withColumn("at", F.expr("at + INTERVAL 90 SECONDS")).crossJoin(F.broadcast(last)).filter("at <= last").drop("last")
    events = events.unionByName(again).drop("late")
    events.repartitionByRange(4, "at").sortWithinPartitions("at").write.parquet(f"{folder}/in")

    def work(group_id: int, payload: str, attempt: int) -> None:
        if attempt <= int(payload):
            raise RuntimeError("not yet")

    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    with W.timers(spark):
        steps = jobs.run_once(W.worked(stream, work), "queue", folder)
    last = F.max_by(F.struct("state", "attempts"), F.struct("at", -F.col("attempts")))
    return steps.groupBy(F.col("group_id").alias("doc_id")).agg(last.alias("s")).select("doc_id", "s.state", "s.attempts")


#: Answers of models: JSON, in prose and fences, with single quotes and bare names, cut off, and none.
ANSWERED = "CASE event_id % 6 WHEN 0 THEN concat('{\"k\": ', event_id, ', \"s\": [1, 2]}') WHEN 1 THEN concat('Sure! ```json', chr(10), '{\"k\": ', event_id, ', \"s\": [1, 2,]}', chr(10), '``` Bye.') WHEN 2 THEN concat('{', chr(39), 'k', chr(39), ': ', event_id, ', s: ', chr(39), 'it', chr(39), ', }') WHEN 3 THEN concat('It is {\"k\": ', event_id, ', \"s\": [1, 2') WHEN 4 THEN event_type ELSE concat('[{', chr(39), 'k', chr(39), ': ', event_id, '}, True, None]') END"


@query("SELECT event_id, CASE event_id % 6 WHEN 2 THEN '{\"k\": ' || event_id || ', \"s\": \"it\"}' WHEN 4 THEN NULL WHEN 5 THEN '[{\"k\": ' || event_id || '}, true, null]' ELSE '{\"k\": ' || event_id || ', \"s\": [1, 2]}' END AS json FROM events")
def json_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of models' answers, repaired where it must be."""
    return T.dealt(T.raw(spark, sf_dir, "events")).select("event_id", model_json(F.expr(ANSWERED)).alias("json"))


# Evidence.

#: Notes with links of every kind: named ones, one that is the name of another, pairs of parentheses, punctuation behind, repeats, none.
NOTE = (
    "concat('See [the  page](', url, '), [https://github.com/o/r', page_id, '](https://b.org/x_(', page_id, ')) and (http://c.com/a_(b)). ', CASE page_id % 4 WHEN 0 THEN concat('<', url, '>, or \"https://t.me/c/', page_id, '\"... ') "
    "WHEN 1 THEN repeat('word and ', 40) WHEN 2 THEN concat('https://www.youtube.com/watch?v=', page_id, '}*! ') ELSE 'http:// [no](https://) ' END, CASE WHEN page_id % 3 = 0 THEN html ELSE '' END)"
)
_W = r"\s\x0B\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MD, _URL = rf"\[([^\]\n]{{1,200}})\]\((https?://(?:[^{_W}()]|\([^{_W}()]*\))+)\)", rf"https?://[^{_W}<>\]\"'']+"
_AT = "list_transform(range(1, len({w}) + 1), lambda i: list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({w}[1:i - 1], lambda x: length(x))), 0))"
LINKS_SQL = rf"""ma AS (SELECT page_id, t, regexp_extract_all(t, '{_MD}', 0) AS w, regexp_extract_all(t, '{_MD}', 1) AS l, regexp_extract_all(t, '{_MD}', 2) AS u, string_split_regex(t, '{_MD}') AS b FROM nt),
m AS (SELECT page_id, unnest(w) AS w, unnest(l) AS l, unnest(u) AS u, unnest({_AT.format(w="w")})::BIGINT AS p0, unnest(range(len(w))) AS i, t FROM ma),
ua AS (SELECT page_id, t, regexp_extract_all(t, '{_URL}') AS w, string_split_regex(t, '{_URL}') AS b FROM nt),
u AS (SELECT page_id, unnest(w) AS w, unnest({_AT.format(w="w")})::BIGINT AS p0, unnest(range(len(w))) AS i, t FROM ua),
al AS (SELECT page_id, 0 AS k, i, w, u, nullif(trim(regexp_replace(l, '\s+', ' ', 'g')), '') AS label, p0, t FROM m
 UNION ALL SELECT page_id, 1, i, w, w, NULL, p0, t FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = u.page_id AND u.p0 >= m.p0 + length(m.l) + 3 AND u.p0 < m.p0 + length(m.l) + 3 + length(m.u))),
cu AS (SELECT *, regexp_replace(u, '[.,;:!?\]}}*]+$', '') AS c FROM al),
cl AS (SELECT *, left(c, length(c) - least(greatest(length(replace(c, '(', '')) - length(replace(c, ')', '')), 0), length(regexp_extract(c, '\)*$')))) AS url, greatest(p0 - 110, 0) AS s, least(p0 + length(w) + 110, length(t)) AS e FROM cu),
cx AS (SELECT *, CASE WHEN s > 0 THEN '... ' ELSE '' END || trim(regexp_replace(t[s + 1:e], '[ \t\n\r\f\v]+', ' ', 'g')) || CASE WHEN e < length(t) THEN ' ...' ELSE '' END AS context FROM cl WHERE regexp_matches(url, '^https?://[^/?#]'))"""

TERMS = {"practitioner": ["ouren", "blethe"], "announcement": ["eral", "released"], "analysis": ["thion", "ction"]}
LOW = ["thanks", "the"]
STYPE = f"CASE WHEN {X.any_sql('t', TERMS['practitioner'])} THEN 'practitioner_experience' WHEN {X.any_sql('t', TERMS['announcement'])} AND links > 0 THEN 'tool_release' WHEN {X.any_sql('t', TERMS['announcement'])} THEN 'announcement' WHEN {X.any_sql('t', TERMS['analysis'])} THEN 'analysis' WHEN c > 0 AND c < 360 THEN 'mention' ELSE 'unknown' END"
#: A third of the documents end with links, two of them alike.
SOURCED = "concat(text, CASE WHEN doc_id % 3 = 0 THEN concat(' Code: https://github.com/o/r', doc_id % 7, ', [site](https://e.org) and https://e.org.') ELSE '' END)"
EV = f"""nt AS (SELECT doc_id AS page_id, {SOURCED} AS t FROM docs WHERE text IS NOT NULL), {LINKS_SQL}, lk AS (SELECT page_id AS doc_id, count(DISTINCT url) AS links FROM cx GROUP BY 1),
x AS (SELECT doc_id, lower({SOURCED}) AS t, length(trim({SOURCED})) AS c, coalesce(links, 0) AS links, created_at, source_id, n, CASE WHEN n >= 2400 THEN 'HIGH' ELSE 'MEDIUM' END AS rel FROM docs LEFT JOIN lk USING (doc_id)),
cc AS (SELECT doc_id, count(*) FILTER (kind = 'author') AS a, count(*) FILTER (kind = 'community') AS m,
 avg(CASE WHEN kind = 'community' THEN (len(list_filter(string_split_regex(lower(trim(comment_text)), '\\s+'), lambda w: w <> '')) <= 4 OR {X.any_sql('lower(trim(comment_text))', LOW)})::INT END) AS noise FROM comments GROUP BY doc_id),
y AS (SELECT x.*, coalesce(a, 0) AS a, coalesce(m, 0) AS m, coalesce(noise, 0) AS noise, {STYPE} AS kind FROM x LEFT JOIN cc USING (doc_id)),
z AS (SELECT *, CASE WHEN a > 0 AND m > 0 THEN 'mixed' WHEN a > 0 THEN 'author_support' WHEN m > 0 AND noise >= 0.7 THEN 'mostly_noise' WHEN m > 0 THEN 'community_support' ELSE 'none' END AS signal,
 CASE WHEN kind IN ('announcement', 'mention') THEN 'shallow' WHEN kind = 'tool_release' AND c < 700 THEN 'shallow' WHEN kind = 'practitioner_experience' AND (rel = 'HIGH' OR a > 0 OR c >= 260) THEN 'deep_practical' WHEN kind = 'analysis' AND c >= 700 THEN 'deep_practical'
 WHEN c >= 450 OR a + m > 0 OR rel = 'HIGH' THEN 'moderate' WHEN c > 0 THEN 'shallow' ELSE 'unknown' END AS depth FROM y)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = F.avg(F.when(F.col("kind") == "community", V.is_noise(F.col("comment_text"), LOW).cast("int")))
    of = lambda k: F.count_if(F.col("kind") == k)
    c = T.comments(spark, sf_dir).groupBy("doc_id").agg(of("author").alias("a"), of("community").alias("m"), noise.alias("noise"))
    d = T.docs(spark, sf_dir).withColumn("text", F.expr(SOURCED))
    linked = V.links_of(d).groupBy("doc_id").agg(F.count("*").alias("links"))
    d = d.select("doc_id", "source_id", "created_at", "n", F.lower("text").alias("t"), F.char_length(F.trim("text")).alias("c"), F.when(F.col("n") >= 2400, "HIGH").otherwise("MEDIUM").alias("rel"))
    rows = d.join(c, "doc_id", "left").join(linked, "doc_id", "left").fillna(0, ["a", "m", "noise", "links"])
    rows = rows.withColumn("kind", V.source_type(F.col("t"), F.col("c"), F.col("links"), TERMS)).withColumn("signal", V.comment_signal(F.col("a"), F.col("m"), F.col("noise")))
    rows = rows.withColumn("depth", V.depth(F.col("kind"), F.col("rel"), F.col("c"), F.col("a"), F.col("m")))
    return rows.withColumn("confidence", V.confidence(F.col("kind"), F.col("depth"), F.col("rel"), F.col("signal")))


CONFIDENCE = """CASE WHEN depth = 'deep_practical' AND rel = 'HIGH' AND signal IN ('author_support', 'mixed', 'community_support') THEN 'high'
 WHEN rel = 'HIGH' AND signal IN ('author_support', 'mixed', 'community_support') AND depth <> 'unknown' THEN 'medium' WHEN depth = 'shallow' OR kind IN ('announcement', 'mention') THEN 'low'
 WHEN rel = 'HIGH' OR depth IN ('deep_practical', 'moderate') THEN 'medium' ELSE 'low' END"""


@query(f"WITH {D}, {CM}, {EV} SELECT doc_id, kind, signal, depth, {CONFIDENCE} AS confidence FROM z")
def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("doc_id", "kind", "signal", "depth", "confidence")


@query(f"""WITH {D}, {CM}, {EV} SELECT doc_id, array_to_string(list_filter([CASE WHEN depth = 'shallow' THEN 'short or announcement-like source' END, CASE WHEN kind IN ('announcement', 'tool_release') THEN 'announcement/release signal, not deep analysis' END,
 CASE WHEN signal = 'mostly_noise' THEN 'comments mostly noise' WHEN signal <> 'none' THEN 'comments: ' || signal END, CASE WHEN links > 0 THEN 'external links are author-supplied and not fetched' END], lambda s: s IS NOT NULL), '; ') AS notes FROM z""")
def evidence_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("doc_id", V.notes(F.col("kind"), F.col("depth"), F.col("signal"), F.col("links")).alias("notes"))


@query(f"""WITH {D}, {CM}, {EV}, {T.LINKS_SQL.replace("n AS (", "nn AS (").replace("% n)", "% nn.n)").replace(", n)", ", nn)")}, ln AS (SELECT src AS doc_id, count(*) AS k FROM links GROUP BY 1)
SELECT source_id || ':' || doc_id AS source_key, source_id AS expert_id, doc_id::VARCHAR AS telegram_message_id, rel AS relevance, strftime(created_at, '%Y-%m-%d') AS created_at, CASE doc_id % 3 WHEN 0 THEN 'first  of ' || doc_id ELSE '' END AS reason,
 depth AS evidence_depth, kind AS source_type, signal AS comment_signal, {CONFIDENCE} AS confidence, z.links::VARCHAR AS external_links_count, a::VARCHAR AS author_comments_count, m::VARCHAR AS community_comments_count, coalesce(k, 0)::VARCHAR AS linked_context_count, n::VARCHAR AS content_chars
FROM z LEFT JOIN ln USING (doc_id)""")
def sink_index_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all sources as tab-separated files, read back. Some are listed twice, the second time with other values, and have reasons with tabs and ends of lines."""
    path = shared_path(spark, "index-tsv")
    linked = T.links(spark, sf_dir).groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("k"))
    e, c = evidence(spark, sf_dir).join(linked, "doc_id", "left"), F.col
    reason = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("\tfirst\r\nof "), "doc_id", F.lit("\n")))
    cells = (
        F.concat_ws(":", "source_id", "doc_id"), c("source_id"), c("doc_id"), c("rel"), F.date_format("created_at", "yyyy-MM-dd"), reason, c("depth"), c("kind"), c("signal"), c("confidence"),
        c("links"), c("a"), c("m"), F.coalesce("k", F.lit(0)), c("n"),
    )
    rows = e.select(*(x.alias(name) for x, name in zip(cells, E.INDEX, strict=True)), c("doc_id").alias("place"))
    again = rows.filter(c("place") % 5 == 0).withColumn("relevance", F.lit("LOW")).withColumn("place", c("place") + (1 << 40))
    E.write_index(rows.unionByName(again), "place", path)
    back = spark.read.schema(", ".join(f"{n} string" for n in E.INDEX)).csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="\0")
    return back.fillna("")


@query(f"WITH {D}, {CM}, {EV} SELECT doc_id FROM z WHERE signal = 'mostly_noise'")
def comments_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).filter("signal = 'mostly_noise'").select("doc_id")


@query(rf"""WITH nt AS (SELECT page_id, {NOTE} AS t FROM pages), {LINKS_SQL} SELECT page_id, url, label, context FROM cx QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY k, i) = 1""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of a note about each page, with their labels and what stands around them."""
    notes = T.raw(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.expr(NOTE).alias("text"))
    return V.links_of(notes).select(F.col("doc_id").alias("page_id"), "url", "label", "context")


#: Messages with and without a pattern, and status codes; what the class is of each.
ERROR = (
    "CASE event_id % 13 WHEN 0 THEN 'HTTP 402 Payment  Required' WHEN 1 THEN concat(event_type, ': Quota for user ', user_id, ' EXCEEDED') WHEN 2 THEN 'rate limit' WHEN 3 THEN concat('Malformed request ', event_id) WHEN 4 THEN 'Access denied' "
    "WHEN 5 THEN concat('model ', event_type, ' was not found') WHEN 6 THEN 'Connection to host refused' WHEN 7 THEN '503 Service Unavailable' WHEN 8 THEN '' WHEN 9 THEN 'too many requests: server error' ELSE concat(event_type, ' failed') END"
)
STATUS_CODE = "CASE event_id % 17 WHEN 0 THEN 402 WHEN 1 THEN 429 WHEN 2 THEN 422 WHEN 3 THEN 403 WHEN 4 THEN 504 WHEN 5 THEN 418 END"


@query(f"""SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'payment_required' WHEN 1 THEN 'payment_required' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'invalid_request' WHEN 4 THEN 'insufficient_permissions' WHEN 5 THEN 'model_unavailable' WHEN 6 THEN 'network_error'
 WHEN 7 THEN 'server_error' WHEN 8 THEN 'unknown_error' WHEN 9 THEN 'rate_limit' ELSE CASE {STATUS_CODE} WHEN 402 THEN 'payment_required' WHEN 429 THEN 'rate_limit' WHEN 422 THEN 'invalid_request' WHEN 403 THEN 'insufficient_permissions' WHEN 504 THEN 'server_error' ELSE 'unknown_error' END END AS class FROM events""")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw(spark, sf_dir, "events").select("event_id", V.error_class(F.expr(ERROR), F.expr(STATUS_CODE)).alias("class"))


#: Each document as an answer in a scenario of its own: with and without what each check looks for.
SAYS = (
    "concat(CASE WHEN doc_id % 9 = 0 THEN '  {' ELSE '' END, text, ' [', source, ':', doc_id, '] [', source, ':', doc_id + 1, ']', CASE WHEN doc_id % 4 = 0 THEN ' of Tech &  Business' ELSE '' END, "
    "CASE WHEN doc_id % 3 = 0 THEN ' query_sent experts_sent response_mode target: WARNINGS, source_refs and source_key; caveat: похоже' ELSE ' source_expand target mode' END, CASE WHEN doc_id % 11 = 0 THEN ' It is a proven  fact.' ELSE '' END, "
    "CASE WHEN doc_id % 13 = 0 THEN ' I fetched external pages' ELSE '' END)"
)
#: Of a scenario what the SQL and the query both say; the rest is null and so as by default.
MODE, GROUP, FORBIDDEN, COVER = "CASE WHEN doc_id % 5 = 0 THEN 'source_expand' ELSE 'expert_digest' END", "CASE WHEN doc_id % 2 = 0 THEN 'tech_business' END", "CASE WHEN doc_id % 7 < 3 THEN 'target: w' END", "array('license', 'ouren')"
KNOWN = "CASE doc_id % 5 WHEN 0 THEN concat('none:', doc_id) WHEN 1 THEN NULL ELSE concat(source, ':', doc_id) END"
_N = "len(list_filter([{}], lambda t: contains(low, t)))"
_LOW = lambda terms: _N.format(", ".join(f"'{t}'" for t in terms))
CHECKS_SQL = rf"""a0 AS (SELECT *, {SAYS} AS answer, {MODE} AS mode, {GROUP} AS grp, {FORBIDDEN} AS bad, {KNOWN} AS known FROM documents),
a AS (SELECT *, lower(regexp_replace(trim(answer, E' \t\n\r\f\v'), '[ \t\n\r\f\v]+', ' ', 'g')) AS low, length(answer) AS size FROM a0),
f AS (SELECT *, {_LOW(A.PROOF)} > 0 AS proof, {_LOW(A.FETCHED)} > 0 AS fetched, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE source END AS filter FROM a),
g AS (SELECT *, list_distinct(regexp_extract_all(answer, '(?i)\b([a-z][a-z0-9_]+:[0-9]+)\b', 1)) AS cited, len(CASE WHEN filter IS NULL THEN [] ELSE [filter] END) AS n_filter FROM f),
h AS (SELECT *, CASE WHEN known IS NOT NULL THEN len(list_filter(cited, lambda k: k = known)) WHEN len(list_filter(cited, lambda k: split_part(k, ':', 1) = filter)) > 0 THEN len(list_filter(cited, lambda k: split_part(k, ':', 1) = filter)) ELSE len(cited) END AS matched FROM g),
c0 AS (SELECT doc_id AS case_id, unnest(['not_raw_json', 'request_passport', 'scope_fidelity', 'source_grounding', 'signal_honesty', 'forbidden_terms', 'coverage', 'relay_delivery', 'brevity', 'expand_path', 'external_boundary']) AS name,
 unnest([1.5, 1.0, 1.0, 1.5, 1.25, CASE WHEN bad IS NULL THEN 0.5 ELSE 1.0 END, 1.5, 1.0, 0.75, 0.75, 0.75]::DOUBLE[]) AS weight,
 unnest([CASE WHEN starts_with(low, '{{') THEN 0 ELSE 1 END, CASE WHEN mode = 'source_expand' THEN {_LOW(A.PASSPORT["source_expand"])} ELSE {_LOW(A.PASSPORT[""])} END / 4,
  CASE WHEN grp IS NULL AND n_filter = 0 THEN 1 ELSE (CASE WHEN grp IS NOT NULL THEN {_LOW(("tech_business", "tech business", "tech & business"))} ELSE 0 END + coalesce(contains(low, filter)::INT, 0)) END, matched / 2,
  CASE WHEN proof THEN 0 ELSE {_LOW(A.CAUTION)} / 2 END, CASE WHEN bad IS NOT NULL AND contains(low, bad) THEN 0 ELSE 1 END, (contains(low, 'license') OR contains(low, 'ouren'))::INT,
  CASE WHEN mode = 'source_expand' THEN {_LOW(A.DELIVERY["source_expand"])} ELSE {_LOW(A.DELIVERY[""])} END / 3, CASE WHEN size > 7000 THEN 7000 / size WHEN size < 700 THEN size / 700 ELSE 1 END, {_LOW(A.EXPAND)}, CASE WHEN fetched THEN 0 ELSE 1 END]::DOUBLE[]) AS score,
 unnest([true, false, false, false, proof, bad IS NOT NULL AND contains(low, bad) AND doc_id % 7 = 0, false, false, false, false, fetched]) AS critical FROM h),
c AS (SELECT case_id, name, weight, round(least(greatest(score, 0), 1), 3) AS score, critical FROM c0)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an answer that cites itself and the next one, by the eleven checks."""
    fields = {"response_mode": MODE, "expert_group": GROUP, "expert_filter": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE array(source) END", "min_source_handles": "2", "forbidden_terms": f"CASE WHEN {FORBIDDEN} IS NULL THEN NULL ELSE array({FORBIDDEN}) END", "forbidden_critical": "doc_id % 7 = 0", "must_cover_any": f"array({COVER})"}
    scenario = F.struct(*(F.expr(fields.get(name, "NULL")).cast(kind).alias(name) for name, kind in A.fields()))
    keys = F.expr(f"CASE WHEN {KNOWN} IS NULL THEN NULL ELSE array({KNOWN}) END")
    checks = A.checks(F.expr(SAYS), scenario, keys, {"tech_business": "tech & business"})
    return T.raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.explode(checks).alias("c")).select("case_id", "c.*")


@query(f"WITH {CHECKS_SQL} SELECT case_id, name, weight, score, critical FROM c")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir)


@query(f"WITH {CHECKS_SQL}, q AS (SELECT case_id, round(sum(weight * score) / sum(weight), 3) AS score, bool_or(critical AND score < 1) AS blocked FROM c GROUP BY case_id) SELECT case_id, score, score >= 0.7 AND NOT blocked AS passed FROM q")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.quality(checked(spark, sf_dir))


EXPAND = "trim(regexp_replace(d.text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"""WITH sd AS (SELECT doc_id, {SOURCED} AS text FROM documents), nt AS (SELECT doc_id AS page_id, text AS t FROM sd), {LINKS_SQL},
ls AS (SELECT page_id AS doc_id, string_agg(CASE WHEN starts_with(url, 'https://github.com/') THEN 'github_repo ' ELSE 'web ' END || url, ', ' ORDER BY k, i) AS links FROM (SELECT * FROM cx QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY k, i) = 1) GROUP BY 1),
k AS (SELECT vec_id * 3 AS doc_id FROM embeddings), c AS (SELECT conv_id AS doc_id, count(*) AS n, string_agg(turn, ',' ORDER BY turn) FILTER (r <= 3) AS turns FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1)
SELECT k.doc_id, d.doc_id IS NOT NULL AS found, CASE WHEN length({EXPAND}) > 200 THEN rtrim(left({EXPAND}, 197)) || '...' ELSE {EXPAND} END AS content, length({EXPAND}) > 200 AS cut, coalesce(turns, '') AS comments, greatest(coalesce(n, 0) - 3, 0) AS omitted, coalesce(links, '') AS links
FROM k LEFT JOIN sd d ON d.doc_id = k.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN ls ON ls.doc_id = d.doc_id""")
def expand_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with their clipped contents, links, first comments and what is left out; keys that aren't known are told so."""
    keys = T.vectors(spark, sf_dir).select((F.col("vec_id") * 3).alias("doc_id"))
    return V.expanded(keys, T.docs(spark, sf_dir).withColumn("text", F.expr(SOURCED)), T.comments(spark, sf_dir), 200, 3)


@query(f"""WITH {D}, {T.LINKS_SQL}, s AS (SELECT source_id, doc_id FROM docs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY docs.n DESC, doc_id) <= 10), c AS (SELECT conv_id AS doc_id, count(*) AS k FROM conversations GROUP BY 1), l AS (SELECT src AS doc_id, count(*) AS k FROM links GROUP BY 1), t AS (SELECT source_id, count(*) AS sources FROM docs GROUP BY 1),
a AS (SELECT source_id, count(*) AS shown, coalesce(sum(c.k), 0)::BIGINT AS comments, coalesce(sum(least(coalesce(c.k, 0), 3)), 0)::BIGINT AS shown_comments, coalesce(sum(l.k), 0)::BIGINT AS links FROM s LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) GROUP BY 1)
SELECT source_id, sources, shown, sources - shown AS omitted, comments, shown_comments, comments - shown_comments AS omitted_comments, links FROM t JOIN a USING (source_id)""")
def digest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a digest of the ten longest documents of each source shows and leaves out, with three comments of each."""
    d = T.docs(spark, sf_dir).select("source_id", "doc_id", "n")
    best = top(d, 10, [F.desc("n"), F.col("doc_id")]).select("doc_id", F.col("rank").alias("place"))
    index = d.select("source_id", "doc_id").join(best, "doc_id", "left")
    return V.digest_counts(index, T.comments(spark, sf_dir).select("doc_id"), T.links(spark, sf_dir).select("src"), 10, 3)


@query("""WITH d AS (SELECT doc_id, source || ':' || doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN '' ELSE regexp_extract(text, '[a-z]+') END AS claim FROM documents)
SELECT doc_id, CASE WHEN claim <> '' THEN claim || '|' || CASE doc_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' ELSE 'unknown' END || '|' || key ELSE CASE WHEN doc_id % 8 = 0 THEN 'reason' ELSE key END || '|direct|' || key END AS signal FROM d""")
def digest_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a model's answer in JSON, as far as they claim something, with a known level of support and known sources; where none is left, what was selected speaks for itself."""
    n, key = F.col("doc_id"), F.concat_ws(":", "source_id", "doc_id")
    claim = F.when(n % 4 == 0, "  ").otherwise(F.regexp_extract("text", "[a-z]+", 0))
    level = F.when(n % 3 == 0, "direct").when(n % 3 == 1, " indirect ").otherwise("odd")
    raw = lambda *fields: F.struct(*(f.alias(k) for k, f in zip(("claim", "support_level", "supporting_sources"), fields, strict=True)))
    answer = F.to_json(F.struct(F.array(raw(F.lit(None).cast("string"), level, F.array(key)), raw(claim, level, F.array(F.lit("none:0"), key))).alias("key_signals")))
    parsed = F.from_json(answer, "key_signals array<struct<claim:string,support_level:string,supporting_sources:array<string>>>")
    refs = F.array(F.struct(key.alias("source_key"), F.when(n % 8 == 0, "reason").alias("reason")))
    made = V.signals(parsed["key_signals"], refs, 6)
    out = T.docs(spark, sf_dir).select("doc_id", F.explode(made).alias("s"))
    return out.select("doc_id", F.concat_ws("|", "s.claim", "s.support_level", F.array_join("s.sources", ",")).alias("signal"))


ARTIFACTS = "a AS (SELECT doc_id AS request_id, unnest([source, source, lang, lang, lang, lang, source]) AS source_id, 'k' || unnest([doc_id % 7, doc_id % 5, doc_id % 3, doc_id % 5, doc_id % 11, doc_id % 2, doc_id % 13]) AS source_key, unnest(range(7)) AS pos FROM documents)"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in JSON, written and read back: two sources, and two experts with main sources, of which one has a digest."""
    from ..sources.exports import results

    n, path = F.col("doc_id"), shared_path(spark, "artifacts")
    keys = lambda *m: F.array(*(F.struct(F.concat(F.lit("k"), n % i).alias("source_key")) for i in m))
    found = F.array(*(F.struct(F.col("source_id").alias("expert_id"), F.concat(F.lit("k"), n % i).alias("source_key")) for i in (7, 5)))
    digest = F.struct(keys(11).alias("source_refs"), keys(2).alias("source_index"))
    expert = lambda who, main, of: F.struct(F.col(who).alias("expert_id"), main.alias("main_sources"), of.alias("digest"))
    experts = F.array(expert("lang", keys(3, 5), digest), expert("source_id", keys(13), F.when(F.lit(False), digest)))
    T.docs(spark, sf_dir).select(n.alias("request_id"), found.alias("sources"), experts.alias("experts")).write.json(path)
    return results(spark, path)


@query(f"WITH {ARTIFACTS} SELECT request_id, source_key, arg_min(source_id, pos) AS source_id, min(pos) AS place FROM a GROUP BY ALL")
def artifact_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of results, each key from the first place that has it."""
    return V.artifact_sources(artifacts(spark, sf_dir))


@query(f"WITH {ARTIFACTS} SELECT a.request_id, lang || ',' || source AS experts, 2::BIGINT AS expert_count, count(DISTINCT source_key) AS source_keys_count FROM a JOIN documents ON doc_id = request_id GROUP BY ALL")
def artifact_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.artifact_manifest(artifacts(spark, sf_dir)).withColumn("experts", F.array_join("experts", ","))


X_CLIP = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"

# Community ranking.

POSTS = "ps AS (SELECT doc_id AS post_id, split_part(text, chr(10), 1) AS title, text AS body, doc_id * 13 % 200 AS votes, doc_id * 7 % 60 AS replies, doc_id * 37 % 700 AS age, source AS grp FROM documents)"
WORDS, ANCHORS, KEYS, FIXES, PROMO = ["the", "thin", "reth"], ["ouren", "bleth"], ["eral", "tion"], ["ing", "solution"], ["buy", "erth"]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.raw(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("post_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), (F.col("doc_id") * 13 % 200).alias("votes"), (F.col("doc_id") * 7 % 60).alias("replies"), (F.col("doc_id") * 37 % 700).alias("age"), F.col("source").alias("grp"))


V1 = f"""(CASE WHEN grp = 'src0' THEN 3 ELSE 1 END) * 10 + (CASE WHEN age < 365 THEN 10 * (1 - age / 365.0::DOUBLE) ELSE 0 END) + least(votes / sqrt(greatest(age, 1)) / 10, 30) + least(replies / 5, 10)
 - {X.n_sql('lower(title)', Q.CLICKBAIT)} * 3 + {X.n_sql('lower(title)', Q.TECHNICAL)} * 2"""


@query(f"WITH {POSTS} SELECT post_id, round({V1}, 6) AS score FROM ps")
def score_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, priority = F.col, F.when(F.col("grp") == "src0", 3).otherwise(1)
    return posts(spark, sf_dir).select("post_id", F.round(Q.simple_score(c("title"), c("votes"), c("replies"), c("age"), priority), 6).alias("score"))


BOTH = "concat_ws(' ', lower(title), lower(body))"
V2 = f"""greatest(0.0, least(least(({X.n_sql('lower(title)', WORDS)} * 0.65 + {X.n_sql('lower(body)', WORDS)} * 0.30) / 3, 1.0)::DOUBLE * 0.58 + least({X.n_sql(BOTH, KEYS)} * 0.08, 0.24)::DOUBLE
 + (CASE WHEN {X.any_sql(BOTH, FIXES)} THEN 0.10 ELSE 0 END) + least(ln(1 + votes) / 8, 0.18) + least(ln(1 + replies) / 10, 0.10)
 - (CASE WHEN {X.n_sql(BOTH, ANCHORS)} = 0 THEN 0.28 WHEN {X.n_sql(BOTH, ANCHORS)} = 1 THEN 0.10 ELSE 0 END) - (CASE WHEN {X.any_sql('lower(title)', PROMO)} THEN 0.35 ELSE 0 END)
 - (CASE WHEN votes <= 1 AND replies <= 2 AND length(body) < 120 THEN 0.12 ELSE 0 END), 1.4))"""


def precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return posts(spark, sf_dir).withColumn("score", Q.precise_score(c("title"), c("body"), c("votes"), c("replies"), WORDS, ANCHORS, KEYS, FIXES, PROMO))


@query(f"WITH {POSTS} SELECT post_id, round({V2}, 6) AS score FROM ps")
def score_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precise(spark, sf_dir).select("post_id", F.round("score", 6).alias("score"))


SURE = f"""s AS (SELECT post_id, grp, round({V2}, 9) AS score, {X.n_sql(BOTH, ANCHORS)} AS hits, contains(lower(body), 'the') AS compared FROM ps)"""


def gate_sql(intent: str, strict: str, soft: str) -> str:
    """``s`` through a gate of one intent: rows that are allowed, strictly or not, and the first of them."""
    return f"""SELECT '{intent}' AS intent, grp, post_id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, post_id) AS k FROM (SELECT *, bool_or(st) OVER (PARTITION BY grp) AS sure FROM (SELECT *, score >= 0.52 AND {strict} AS st, score >= 0.44 AND {soft} AS so FROM s) WHERE st OR so)
     WHERE st OR NOT sure) WHERE k <= CASE WHEN sure THEN 12 ELSE 4 END"""


@query(f"WITH {POSTS}, {SURE} {gate_sql('any', 'true', 'true')} UNION ALL {gate_sql('anchored', 'hits > 0', 'hits > 0')} UNION ALL {gate_sql('comparison', 'hits > 0 AND NOT (hits >= 2 AND NOT compared)', 'hits > 0')}")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each group, if anything will do, if an anchor must be there, and for a comparison."""
    both = F.concat_ws(" ", F.lower("title"), F.lower("body"))
    hits = X.n_of(both, ANCHORS)
    rows = precise(spark, sf_dir).select("post_id", "grp", F.round("score", 9).alias("score"), hits.alias("anchor_hits"), hits.alias("title_anchor_hits"), F.contains(F.lower("body"), F.lit("the")).cast("int").alias("compared"))
    rows = written(rows, "scored")  # each gate reads it twice, and the texts are read once
    of = lambda name, **rules: Q.gated(rows, "grp", 12, **rules).select(F.lit(name).alias("intent"), "grp", "post_id")
    return of("any").unionByName(of("anchored", anchors=True)).unionByName(of("comparison", comparison=True))


NK = X.n_sql("lower(title)", KEYS)
BOOST = f"((CASE WHEN post_id % 10 = 0 THEN 1.2::DOUBLE ELSE 1 END) * (CASE WHEN {NK} > 0 THEN least(1 + {NK} * 0.5, 3)::DOUBLE ELSE 1 END))"


@query(f"""WITH {POSTS}, s AS (SELECT post_id, round(CASE WHEN post_id % 10 = 0 OR {BOOST} > 1.5 THEN (votes + replies * 2) * {BOOST} ELSE (votes + replies * 2) * {BOOST} / power(age * 24 + 2, 1.5) END, 6) AS score, CASE WHEN post_id % 3 <> 0 THEN (post_id % 10) / 10.0::DOUBLE END AS ai FROM ps), b AS (SELECT * FROM s ORDER BY score DESC, post_id LIMIT 40)
SELECT post_id, score, 1 AS tier, row_number() OVER (ORDER BY coalesce(ai, 0.5) DESC, score DESC, post_id) AS place FROM b UNION ALL SELECT post_id, score, 2, 0 FROM s WHERE post_id NOT IN (SELECT post_id FROM b)""")
def hot_score_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best forty in order of a model's opinion, then the rest."""
    c = F.col
    score = F.round(Q.hot_score(c("title"), c("votes"), c("replies"), c("age") * 24, KEYS, c("post_id") % 10 == 0), 6)
    return Q.tiered(posts(spark, sf_dir).select("post_id", score.alias("score"), F.when(c("post_id") % 3 != 0, c("post_id") % 10 / 10).alias("ai")), 40).drop("ai").fillna(0, ["place"])


@query(f"WITH {POSTS} SELECT post_id, round(coalesce(CASE WHEN post_id % 3 <> 0 THEN (post_id % 10) / 10.0::DOUBLE END, 0.5) * 0.72 + least({V2} / 1.4, 1.0) * 0.23 + least(ln(1 + votes + replies) / 8, 1.0) * 0.05, 6) AS score FROM ps")
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    ai = F.when(F.col("post_id") % 3 != 0, F.col("post_id") % 10 / 10)
    return precise(spark, sf_dir).select("post_id", F.round(Q.blended(ai, F.col("score"), F.col("votes") + F.col("replies")), 6).alias("score"))


@query(f"WITH {POSTS} SELECT post_id, row_number() OVER (ORDER BY votes + 2 * replies DESC, post_id) AS place FROM ps WHERE votes >= 5 ORDER BY place LIMIT 25")
def proxy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = posts(spark, sf_dir).filter("votes >= 5").orderBy(F.desc(F.col("votes") + 2 * F.col("replies")), "post_id").limit(25)
    return best.select("post_id", F.row_number().over(Window.orderBy(F.desc(F.col("votes") + 2 * F.col("replies")), "post_id")).cast("long").alias("place"))


@query("SELECT post_id, max(votes) AS votes, string_agg(DISTINCT s, ',' ORDER BY s) AS strategies, arg_min(s, p) AS first_strategy FROM (SELECT doc_id AS post_id, doc_id * 13 % 200 AS votes, 'hot' AS s, doc_id % 5 AS p FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, doc_id * 17 % 90, 'new', 2.5 FROM documents WHERE doc_id % 3 = 0) GROUP BY post_id")
def multi_strategy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    hot = p.filter("post_id % 2 = 0").select("post_id", "votes", "replies", "body", F.lit("hot").alias("strategy"), (F.col("post_id") % 5).cast("double").alias("pos"))
    new = p.filter("post_id % 3 = 0").select("post_id", (F.col("post_id") * 17 % 90).alias("votes"), "replies", "body", F.lit("new").alias("strategy"), F.lit(2.5).alias("pos"))
    return Q.merged(hot.unionByName(new)).select("post_id", "votes", "strategies", "first_strategy")


@query()
def dedup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.raw(spark, sf_dir, "pages").select(F.col("page_id").alias("post_id"), F.col("page_id").alias("pos"), "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return Q.fuzzy_unique(p).select("post_id")


@query("SELECT item_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), lambda t: length(t) >= 3 AND t NOT IN ('the', 'and')))::INT AS n FROM benchmark")
def terms_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw(spark, sf_dir, "benchmark").select("item_id", F.size(Q.terms(F.col("text"), ["the", "and"])).alias("n"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '(llm OR "large language model") ' || source WHEN 1 THEN source || ' (RAG OR "retrieval augmented generation") d' || doc_id ELSE 'llm OR ' || source END AS expression FROM documents""")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 3
    question = F.when(n == 0, F.concat(F.lit("llm  "), "source_id")).when(n == 1, F.concat("source_id", F.lit(" RAG d"), "doc_id")).otherwise(F.concat(F.lit("llm OR "), "source_id"))
    return T.docs(spark, sf_dir).select("doc_id", Q.expanded(question, {"llm": "large language model", "rag": "retrieval augmented generation"}).alias("expression"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '("text to speech" OR "TTS") engines of ' || source WHEN 1 THEN '("containers" OR "docker") ' || source || ' or -kvm' WHEN 2 THEN 'docker -docker ' || source ELSE 'mtts ' || lang END AS expression FROM documents""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the variants of their keywords, and their negative terms."""
    n = F.col("doc_id") % 4
    question = F.when(n == 0, F.concat(F.lit("Tts engines of "), "source_id")).when(n == 1, F.concat("source_id", F.lit(" or -kvm Docker"))).when(n == 2, F.concat(F.lit("docker -docker "), "source_id")).otherwise(F.concat(F.lit("mtts "), "lang"))
    return T.docs(spark, sf_dir).select("doc_id", Q.expanded_variants(question, {"tts": ["text to speech", "TTS"], "docker": ["containers", "docker"]}).alias("expression"))


@query("SELECT item_id, array_to_string(list_slice(list_filter(list_distinct_in_order, lambda t: length(t) >= 4 AND t NOT IN ('from', 'that')), 1, 3), ' ') AS anchors FROM (SELECT item_id, list_filter(x, lambda t, i: list_position(x, t) = i) AS list_distinct_in_order FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS x FROM benchmark))")
def anchor_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three terms of a question that tell it from others: of four letters and more, without generic words."""
    found = Q.terms(F.col("text"), ["from", "that"], 4)
    return T.raw(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(found, 1, 3), " ").alias("anchors"))


#: Groups by keywords of the synthetic corpus; a caller brings its own.
PLACES = {"the": ["general", "that", "thin"], "thin": ["thin", "a group of a long name"], "reth": ["reth", "bleth", "from"], "ouren": ["ouren"]}
POPULAR = ["general", "reth"]


@query(f"""WITH q AS (SELECT item_id, lower(text) AS low, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS tk FROM benchmark), q1 AS (SELECT *, list_filter(tk, lambda t, i: list_position(tk, t) = i) AS tu FROM q),
q2 AS (SELECT *, list_filter(tu, lambda t: length(t) >= 4 AND t NOT IN ('from', 'that'))[1:3] AS anchors, {" || ".join(f"(CASE WHEN contains(low, '{k}') THEN {v} ELSE [] END)" for k, v in PLACES.items())} AS x FROM q1),
q3 AS (SELECT *, CASE WHEN len(x) > 0 THEN list_filter(x, lambda t, i: list_position(x, t) = i)[1:5] ELSE ['general'] END AS gs FROM q2), u AS (SELECT item_id, gs, tk, anchors, unnest(gs) AS g, unnest(range(len(gs))) AS i FROM q3),
r AS (SELECT item_id, g, i, array_to_string(gs, ',') AS picked, 5 * list_contains(anchors, g)::INT + 3 * (list_contains(tk, g) AND length(g) >= 3)::INT + (g NOT IN ('general', 'reth'))::INT + (length(g) <= 16)::INT AS score FROM u)
SELECT item_id, picked, string_agg(g, ',' ORDER BY score DESC, i) AS soft FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i) <= 2) GROUP BY ALL""")
def subreddit_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five groups for the keywords of a question, and the two of them that tell most."""
    text = F.col("text")
    rows = T.raw(spark, sf_dir, "benchmark").select("item_id", text, Q.picked(text, PLACES, ["general"]).alias("found"))
    soft = Q.soft_targets(F.col("found"), F.slice(Q.terms(text, ["from", "that"], 4), 1, 3), Q.terms(text, []), POPULAR)
    return rows.select("item_id", F.array_join("found", ",").alias("picked"), F.array_join(soft, ",").alias("soft"))


@query("SELECT item_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS clean FROM benchmark")
def text_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw(spark, sf_dir, "benchmark").select("item_id", F.trim(Q.sanitized(F.col("text"))).alias("clean"))


KEYWORDS = ["the", "thin"]
PLAIN = "replace(replace(replace(replace(replace(coalesce(text, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"""WITH RECURSIVE c AS (SELECT conv_id AS post_id, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, role AS author, {PLAIN} AS body, turn * 3 AS score FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY post_id, parent ORDER BY id) AS i FROM c),
t AS (SELECT o.*, 0 AS depth, [i] AS path FROM o WHERE parent IS NULL AND body <> '' UNION ALL SELECT o.*, t.depth + 1, list_append(t.path, o.i) FROM t JOIN o ON o.post_id = t.post_id AND o.parent = t.id WHERE t.depth < 3 AND o.body <> ''),
v AS (SELECT DISTINCT post_id, parent AS id FROM c WHERE author = 'user' AND {X.any_sql('lower(body)', KEYWORDS)}),
s AS (SELECT t.*, v.id IS NOT NULL AS verified, repeat('  ', depth + 1) AS indent, CASE WHEN length(body) > 2000 THEN left(body, 2000) || '... (truncated)' ELSE body END AS b FROM t LEFT JOIN v ON v.post_id = t.post_id AND v.id = t.id),
l AS (SELECT *, indent || CASE WHEN depth > 0 THEN '└─ ' ELSE i || '. ' END || CASE WHEN author = 'user' THEN '[OP] ' ELSE '' END || CASE WHEN verified THEN '[VERIFIED] ' ELSE '' END || '[' || author || ' | Score: ' || score || ']: ' || replace(b, chr(10), chr(10) || indent || '   ') AS line FROM s)
SELECT post_id, count(*) AS n, max(depth) AS depth, count(*) FILTER (verified) AS verified, md5(string_agg(line, chr(10) ORDER BY path)) AS tree_md5 FROM l GROUP BY 1""")
def comment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments as trees of depth 3 at most, each post's rendered; replies hang on the turn of half their number."""
    turn = F.col("turn")
    c = T.raw(spark, sf_dir, "conversations").select(F.col("conv_id").alias("post_id"), turn.alias("comment_id"), F.when(turn > 0, F.floor((turn - 1) / 2)).alias("parent_id"), F.col("role").alias("author"), F.col("text").alias("body"), (turn * 3).alias("score"), F.lit("user").alias("post_author"))
    lines = Q.tree_lines(c, KEYWORDS)
    return Q.rendered(lines).select("post_id", "n", "depth", "verified", F.md5(F.col("tree").cast("binary")).alias("tree_md5"))


# Video segments.

VIDEO = "v AS (SELECT doc_id, source AS video_id, lang AS topic, doc_id * 37 % 700 AS seconds, text, split_part(text, chr(10), 1) AS summary FROM documents)"
MAPPED = "m AS (SELECT *, CASE WHEN length(summary) >= 400 THEN 'HIGH' WHEN length(summary) >= 120 THEN 'MEDIUM' ELSE 'LOW' END AS relevance FROM v)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.docs(spark, sf_dir)
    return d.select("doc_id", F.col("source_id").alias("video_id"), F.col("lang").alias("topic"), (F.col("doc_id") * 37 % 700).alias("seconds"), "text", F.substring_index("text", "\n", 1).alias("summary"))


@query(f"WITH {VIDEO}, {MAPPED} SELECT doc_id, relevance FROM m")
def video_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevance of each segment by a model that sees its summary."""
    return H.mapped(segments(spark, sf_dir)).select("doc_id", "relevance")


@query(f"""WITH {VIDEO}, {MAPPED}, w AS (SELECT DISTINCT video_id, topic FROM m WHERE relevance = 'HIGH'), r AS (SELECT m.video_id, doc_id, seconds, CASE WHEN relevance = 'HIGH' THEN 'HIGH' ELSE 'MEDIUM' END AS shown, CASE WHEN relevance = 'HIGH' THEN text ELSE summary END AS content
 FROM m LEFT JOIN w ON w.video_id = m.video_id AND w.topic = m.topic WHERE relevance IN ('HIGH', 'MEDIUM') OR w.topic IS NOT NULL) SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY seconds, doc_id) AS place, doc_id, shown AS relevance, length(content)::BIGINT AS chars, md5(content) AS content_md5 FROM r""")
def video_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of high relevance in full, those of medium relevance or of a topic of a high one by their summary, in order of time."""
    out = H.resolved(H.mapped(segments(spark, sf_dir)))
    return out.select("video_id", F.col("place").cast("long").alias("place"), "doc_id", "relevance", F.char_length("content").cast("long").alias("chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"""WITH {D}, k AS (SELECT source_id, doc_id, created_at, left({X_CLIP}, 60) AS head FROM docs WHERE n >= 2400 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, doc_id) <= 3)
SELECT source_id, source_id || ': ' || string_agg('[post:' || doc_id || '] ' || head, '; ' ORDER BY created_at DESC, doc_id) AS answer FROM k GROUP BY source_id""")
def synthesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each source from its three newest documents of high relevance, by the default synthesizer."""
    best = P.limited(P.with_relevance(T.docs(spark, sf_dir)).filter("relevance = 'HIGH'"), 3)
    return P.synthesized(best.select("source_id", "doc_id", "place", F.substring(X.squeeze(F.col("text")), 1, 60).alias("excerpt")))
