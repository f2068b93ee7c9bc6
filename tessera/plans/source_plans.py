"""Sources, sinks, scans, filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import markup as K
from ..operators import publishing as P
from ..operators import retrieval as R
from ..operators.funnel import scoped
from ..sources import exports as E
from ..sources import tables as T
from ..sources.shared import shared_path, written
from ..sources.store import Store
from ..streaming.ingest import Ingest
from .registry import query

D = T.DOCS_SQL
STAMP = "strftime(created_at, '%Y-%m-%d')"


def day(c: str = "created_at"):
    return F.date_format(c, "yyyy-MM-dd")


@query(f"WITH {D} SELECT doc_id, source_id, {STAMP} AS day FROM docs WHERE length(text) > 30 AND source_id = 'src0' AND created_at >= TIMESTAMP '2025-01-01' ORDER BY created_at DESC, doc_id LIMIT 100")
def scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.scan(T.docs(spark, sf_dir), "2025-01-01 00:00:00", "src0").orderBy(F.desc("created_at"), "doc_id").limit(100)
    return found.select("doc_id", "source_id", day().alias("day"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 30")
def filter_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.eligible(T.docs(spark, sf_dir)).select("doc_id")


@query(f"WITH {D} SELECT doc_id FROM docs WHERE created_at >= TIMESTAMP '2025-12-31' - INTERVAL 10 MONTH")
def filter_cutoff_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).filter(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{T.AS_OF}' - INTERVAL 10 MONTH")).select("doc_id")


@query("SELECT DISTINCT source AS source_id FROM documents WHERE source IN ('src1', 'src2', 'src99')")
def filter_sources_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).filter(F.col("source_id").isin("src1", "src2", "src99")).select("source_id").distinct()


@query(f"WITH {D} SELECT doc_id, {STAMP} AS day FROM docs WHERE contains(text, 'from the')")
def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).filter(F.contains("text", F.lit("from the"))).select("doc_id", day().alias("day"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def filter_exclude_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = T.raw(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return T.docs(spark, sf_dir).select("doc_id").join(bad, "doc_id", "left_anti")


OFF = ["license", "rights reserved"]


@query(f"SELECT doc_id FROM documents WHERE {X.any_sql('''lower(left(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 240))''', OFF)}")
def filter_offtopic(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring(F.lower(X.squeeze(F.col("text"))), 1, 240)
    return T.docs(spark, sf_dir).filter(X.any_of(head, OFF)).select("doc_id")


@query("SELECT conv_id, turn, coalesce(nullif(text, ''), '[Media only]') AS said, coalesce(nullif(role, 'system'), 'Unknown') AS author FROM conversations")
def coalesce_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.raw(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.coalesce(F.nullif("text", F.lit("")), F.lit("[Media only]")).alias("said"), F.coalesce(F.nullif("role", F.lit("system")), F.lit("Unknown")).alias("author"))


@query("SELECT doc_id, source || ':' || doc_id AS source_key, regexp_full_match(source || ':' || doc_id, '[a-z0-9_]+:[0-9]+') AND doc_id > 0 AS valid FROM documents")
def validate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", "source_id", "doc_id")
    return T.docs(spark, sf_dir).select("doc_id", key.alias("source_key"), (key.rlike("^[a-z0-9_]+:[0-9]+$") & (F.col("doc_id") > 0)).alias("valid"))


#: Groups of sources that a request can name, and what requests ask for.
GROUPS = {"even": ["src2", "src0", "src4"], "small": ["src1", "src3", "src1"]}
SCOPE = "CASE doc_id % 7 WHEN 0 THEN 'all' WHEN 1 THEN 'group' WHEN 2 THEN 'custom' WHEN 3 THEN 'none' WHEN 4 THEN 'some' ELSE 'custom' END"
GROUP = "CASE doc_id % 3 WHEN 0 THEN 'even' WHEN 1 THEN 'small' ELSE 'odd' END"
WANTED = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN {list}(concat(' ', source), 'src3', source, 'src0') WHEN 2 THEN {list}('src1', ' ') WHEN 3 THEN {list}('nobody', source, 'no one') ELSE {list}(source) END"


@query(f"""WITH r AS (SELECT doc_id AS request_id, {SCOPE} AS scope, {GROUP} AS grp, {WANTED.format(list="list_value")} AS raw, doc_id % 2 = 0 AS community FROM documents),
w AS (SELECT *, list_transform(coalesce(raw, []), lambda x: trim(x)) AS ids FROM r), k AS (SELECT list(DISTINCT source ORDER BY source) AS known FROM documents),
e AS (SELECT *, CASE WHEN scope NOT IN ('all', 'group', 'custom', 'none') THEN 'unknown scope' WHEN list_contains(ids, '') THEN 'empty id' WHEN scope = 'group' AND grp NOT IN ('even', 'small') THEN 'unknown group' WHEN scope = 'custom' AND len(ids) = 0 THEN 'no ids'
  WHEN scope = 'custom' AND len(list_filter(ids, lambda x: NOT list_contains(known, x))) > 0 THEN 'unknown ids' WHEN scope = 'none' AND NOT community THEN 'nothing asked for' END AS error FROM w, k),
d AS (SELECT request_id, error, CASE WHEN error IS NOT NULL OR scope = 'none' THEN [] WHEN scope = 'all' THEN known WHEN scope = 'group' THEN CASE grp WHEN 'even' THEN ['src2', 'src0', 'src4'] ELSE ['src1', 'src3'] END ELSE ids END AS l FROM e),
x AS (SELECT request_id, error, unnest(l) AS source_id, unnest(range(1, len(l) + 1)) AS i FROM d), o AS (SELECT request_id, source_id, min(i) AS i FROM x WHERE source_id <> 'src0' GROUP BY ALL)
SELECT request_id, source_id, row_number() OVER (PARTITION BY request_id ORDER BY i) AS pos, NULL AS error FROM o UNION ALL SELECT request_id, NULL, NULL, error FROM d WHERE error IS NOT NULL""")
def resolve_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each request in their order, or what is wrong with it; ``src0`` is shown nowhere."""
    d = T.raw(spark, sf_dir, "documents")
    requests = d.select(F.col("doc_id").alias("request_id"), F.expr(SCOPE).alias("scope"), F.expr(GROUP).alias("group"), F.expr(WANTED.format(list="array")).alias("ids"), (F.col("doc_id") % 2 == 0).alias("community"))
    return scoped(requests, d.select(F.col("source").alias("source_id")), GROUPS, ["src0"])


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table that is in the folder now."""
    return T.counted(spark, T.tables_in(spark, sf_dir))


@query("SELECT conv_id AS doc_id, turn AS comment_id, text AS comment_text FROM conversations WHERE role <> 'system' AND trim(text) <> ''")
def src_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.comments(spark, sf_dir).filter((F.col("kind") != "other") & (F.trim("comment_text") != "")).select("doc_id", "comment_id", "comment_text")


def exported(spark: SparkSession, sf_dir: str) -> str:
    """A chat export of the conversations, as a file of JSON documents (one a conversation) in a folder of its own."""
    path = shared_path(spark, "export")
    c = T.raw(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "service").otherwise("message")
    message = F.struct((F.col("turn") + 1).alias("id"), kind.alias("type"), F.concat(F.lit("2024-01-0"), F.col("turn") % 7 + 1, F.lit("T03:04:05")).alias("date"), F.col("role").alias("from"), "text", F.when(F.col("turn") > 0, F.col("turn")).alias("reply_to_message_id"))
    c.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(message)).alias("messages")).write.mode("overwrite").json(path)
    return path


CHAT_SQL = "SELECT conv_id AS chat_id, turn + 1 AS ext_id, role AS author, text, CASE WHEN turn > 0 THEN turn END AS reply_to FROM conversations WHERE role <> 'system' AND text <> ''"


@query(CHAT_SQL)
def src_chat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chat_messages(spark, exported(spark, sf_dir)).select("chat_id", "ext_id", "author", "text", "reply_to")


@query("""WITH RECURSIVE m AS (SELECT conv_id AS chat_id, turn + 1 AS ext_id, CASE WHEN turn > 0 THEN turn END AS reply_to, text <> '' AS is_text, role, text FROM conversations WHERE role <> 'system' AND turn % 7 <> 6),
w AS (SELECT chat_id, ext_id, ext_id AS cur FROM m UNION ALL SELECT w.chat_id, w.ext_id, m.reply_to FROM w JOIN m ON m.chat_id = w.chat_id AND m.ext_id = w.cur JOIN m p ON p.chat_id = m.chat_id AND p.ext_id = m.reply_to),
e AS (SELECT w.chat_id, w.ext_id, w.cur FROM w JOIN m ON m.chat_id = w.chat_id AND m.ext_id = w.cur WHERE m.reply_to IS NULL AND m.is_text),
r AS (SELECT m.*, coalesce(cur, ext_id) AS root FROM m LEFT JOIN e USING (chat_id, ext_id) WHERE is_text),
p AS (SELECT chat_id, ext_id, 'P' || lpad(row_number() OVER (PARTITION BY chat_id ORDER BY ext_id)::VARCHAR, 4, '0') AS post_ref FROM r WHERE root = ext_id QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY ext_id) <= 3),
c AS (SELECT r.chat_id, r.ext_id, post_ref, post_ref || '.C' || lpad(row_number() OVER (PARTITION BY r.chat_id, r.root ORDER BY r.ext_id)::VARCHAR, 4, '0') AS source_ref FROM r JOIN p ON p.chat_id = r.chat_id AND p.ext_id = r.root WHERE r.root <> r.ext_id)
SELECT chat_id, post_ref AS source_ref, ext_id, post_ref FROM p UNION ALL SELECT chat_id, source_ref, ext_id, post_ref FROM c""")
def src_packet_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three posts of each chat export in a period, with the comments on them."""
    found = E.packet(E.chat_entries(spark, exported(spark, sf_dir)), "2024-01-01", "2024-01-06", 3)
    return found.select("chat_id", "source_ref", "ext_id", "post_ref")


@query("SELECT page_id, lang, CASE WHEN title <> '' THEN title END AS title, length(html)::BIGINT AS size, 1 + (lang <> '')::INT + (title <> '')::INT AS n_fields FROM (SELECT *, regexp_extract(html, '<html lang=\"([^\"]*)', 1) AS lang, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)")
def src_media_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media fields of a page as a map without those that it has not."""
    found = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    fields = {"lang": found('<html lang="([^"]*)'), "title": found("<title>([^<]*)"), "size": F.char_length("html").cast("string")}
    made = F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    return T.raw(spark, sf_dir, "pages").select("page_id", made.alias("m")).select("page_id", F.col("m.lang").alias("lang"), F.col("m.title").alias("title"), F.col("m.size").cast("long").alias("size"), F.size("m").alias("n_fields"))


WORD32 = "('0x' || substr(h, {0}, 8))::UBIGINT::HUGEINT"
MD5_SQL = "(((({} % 1000000000) * 4294967296 + {}) % 1000000000 * 4294967296 + {}) % 1000000000 * 4294967296 + {}) % 1000000000".format(*(WORD32.format(i) for i in (1, 9, 17, 25)))


@query(f"SELECT page_id, ({MD5_SQL})::BIGINT AS video_id, left(md5(url), 12) || '_' || topic AS topic_id FROM (SELECT *, md5(url || '_' || page_id) AS h, CASE WHEN page_id % 3 = 0 THEN 'general' ELSE 't' || page_id % 3 END AS topic FROM pages)")
def src_video_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a video export, read back, with their ids (the md5 of URL and segment modulo 1e9) and topics (those of one video apart from those of others)."""
    path = shared_path(spark, "videos")
    topic = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("t"), F.col("page_id") % 3))
    segment = F.struct(F.col("page_id").alias("segment_id"), topic.alias("topic_id"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    made = T.raw(spark, sf_dir, "pages").groupBy("url").agg(F.collect_list(segment).alias("segments"))
    made.select(F.struct("url").alias("video_metadata"), "segments").write.json(path)
    found = E.video_segments(spark, path)
    return found.select(F.col("segment_id").alias("page_id"), "video_id", "topic_id")


#: Documents up to a part of the last commented one come first, then those up to it, then the rest; comments of a turn above 1 come after the first.
INCOMING = "CASE WHEN doc_id <= (SELECT max(conv_id) * 0.6 FROM conversations) THEN 0 WHEN doc_id <= (SELECT max(conv_id) FROM conversations) THEN 1 ELSE 2 END"


@query(f"""WITH d AS (SELECT doc_id, source, {INCOMING} AS part FROM documents), r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM d WHERE part <= 1),
c AS (SELECT source, count(*) AS comments FROM conversations JOIN d ON conv_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id WHERE part >= 1 OR turn <= 1 OR r <= 10 GROUP BY 1)
SELECT source AS source_id, max(doc_id) AS mark, count(*) AS documents, coalesce(max(comments), 0) AS comments FROM d LEFT JOIN c USING (source) GROUP BY 1""")
def src_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three runs of a stream of files leave of each source: its mark and totals. Later files have rows of earlier ones again, and the second run finds comments that came late."""
    top = shared_path(spark, "ingest")
    d, c = T.raw(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), "text"), T.comments(spark, sf_dir).select("doc_id", "comment_id", "comment_text")
    last = T.raw(spark, sf_dir, "conversations").agg(F.max("conv_id").alias("last"))
    part = F.when(F.col("doc_id") <= F.col("last") * 0.6, 0).when(F.col("doc_id") <= F.col("last"), 1).otherwise(2)
    d = written(d.crossJoin(F.broadcast(last)).withColumn("part", part).drop("last"), "dealt")
    store = Store(spark, f"{top}/store")
    for run in range(3):
        d.filter((F.col("part") == run) | ((F.col("part") == run - 1) & (F.col("doc_id") % 3 == 0))).drop("part").write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(d.drop("part").schema).parquet(f"{top}/in")
        Ingest(store, comments=lambda run=run: c if run else c.filter("comment_id <= 1")).run(stream, f"{top}/checkpoint")
    return store.read("marks")


@query("WITH m AS (SELECT source, count(*) AS n, avg(length(text)) AS mean FROM documents GROUP BY 1) SELECT source AS source_id, n AS docs FROM m WHERE mean >= (SELECT avg(length(text)) FROM documents) OR n % 4 = 0")
def src_passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passport files of the sources that the manifest accepts (here: with texts of the mean length at least) or includes."""
    path, manifest_path = shared_path(spark, "passports"), shared_path(spark, "manifest")
    d = T.docs(spark, sf_dir)
    by = written(d.groupBy("source_id").agg(F.count("*").alias("docs"), F.avg("n").alias("mean")), "by-source")
    by.select("source_id", "docs").write.json(path)
    mean = d.agg(F.avg("n").alias("all"))
    by.crossJoin(F.broadcast(mean)).select("source_id", F.when(F.col("mean") >= F.col("all"), "accepted").otherwise("rejected").alias("verdict"), (F.col("docs") % 4 == 0).alias("include")).write.json(manifest_path)
    manifest = spark.read.schema("source_id string, verdict string, include boolean").json(manifest_path)
    return E.accepted(spark.read.schema("source_id string, docs long").json(path), manifest).select("source_id", "docs")


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def sink_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that was written twice, read back."""
    out, folder = T.raw(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")), shared_path(spark, "results")
    E.write_result(out.limit(1), folder, "r-1")
    E.write_result(out, folder, "r-1")
    return E.read_result(spark, folder, "r-1")


#: Tables in an order in which each comes after those it refers to, with their keys.
COPIED = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "part": "p_partkey"}


#: JSON texts of a table of topics, in several forms, and what they are in one.
LOOSE = "CASE doc_id % 4 WHEN 0 THEN concat(' {\"k\" : ', doc_id, ',  \"a\":[1, 2 ] }') WHEN 1 THEN '{ }' WHEN 2 THEN '' ELSE concat('[', doc_id, ' ]') END"
TIGHT = "CASE doc_id % 4 WHEN 0 THEN concat('{\"a\":[1,2],\"k\":', doc_id, '}') WHEN 3 THEN concat('[', doc_id, ']') END"


@query(" UNION ALL ".join([f"SELECT '{t}' AS name, count(*) AS n, sum({k})::BIGINT AS keys, NULL AS json FROM {t}" for t, k in COPIED.items()] + [f"SELECT 'topics', count(*), sum(doc_id)::BIGINT, md5(string_agg({TIGHT}, '|' ORDER BY doc_id)) FROM documents"]))
def sink_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables copied as one version, parents first, and a table of topics with its JSON in one form; of each copy its rows, the sum of its keys and a digest of the JSON."""
    tables = {name: T.raw(spark, sf_dir, name) for name in COPIED}
    tables["topics"] = T.raw(spark, sf_dir, "documents").select("doc_id", F.expr(LOOSE).alias("topics"))
    store, out = Store(spark, shared_path(spark, "copy")), None
    P.replicate(tables, store, {"topics": ["topics"]}, {"customer": ("c_nationkey", "nation", "n_nationkey"), "orders": ("o_custkey", "customer", "c_custkey")})
    for name, key in (COPIED | {"topics": "doc_id"}).items():
        json = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.col("topics").alias("t")))), lambda x: x["t"]), "|").cast("binary")) if name == "topics" else F.lit(None).cast("string")
        one = store.read(name).agg(F.count("*").alias("n"), F.sum(key).cast("long").alias("keys"), json.alias("json")).select(F.lit(name).alias("name"), "n", "keys", "json")
        out = one if out is None else out.unionByName(one)
    return out


#: Entities of a message by offset: one over others, some at one place, one to the end, one beyond it.
ENTITIES = (
    ("MessageEntityBold", "doc_id % 7", "12"), ("MessageEntityItalic", "doc_id % 7 + 3", "4"), ("MessageEntityTextUrl", "doc_id % 7 + 30", "5"), ("MessageEntityCode", "doc_id % 7 + 30", "3"), ("MessageEntityPre", "50 + doc_id % 3", "6"),
    ("MessageEntityBlockquote", "70", "400"), ("MessageEntityStrike", "20", "2"), ("MessageEntityUnderline", "23", "2"), ("MessageEntitySpoiler", "26", "2"), ("MessageEntityItalic", "length(text) - 1", "50"),
)
_MARKS = {"Bold": "'**' || w || '**'", "Italic": "'*' || w || '*'", "TextUrl": "'[' || w || '](https://e.org/' || doc_id || ')'", "Code": "'`' || w || '`'", "Pre": "'```py' || chr(10) || w || chr(10) || '```'", "Blockquote": "'> ' || replace(w, chr(10), chr(10) || '> ')", "Strike": "'~~' || w || '~~'", "Underline": "'<u>' || w || '</u>'", "Spoiler": "w"}
_MARKED = "CASE " + " ".join(f"WHEN kind = 'MessageEntity{k}' THEN {v}" for k, v in _MARKS.items()) + " END"
#: Each entity's marked text, then all put in from the last place to the first.
ENTITIES_SQL = f"""e AS (SELECT doc_id, text, {", ".join(f"'{k}' AS k{i}, ({o})::BIGINT AS o{i}, {n} AS n{i}" for i, (k, o, n) in enumerate(ENTITIES))} FROM documents WHERE length(text) > 100),
l AS (SELECT doc_id, text, unnest([{", ".join(f"{{'i': {i}, 'kind': k{i}, 'o': o{i}, 'n': n{i}}}" for i in range(len(ENTITIES)))}]) AS x FROM e),
w AS (SELECT doc_id, text, x.i AS i, x.kind AS kind, x.o AS o, x.n AS n, text[x.o + 1:x.o + x.n] AS w FROM l),
m AS (SELECT doc_id, text, list({{'o': o, 'n': n, 'm': {_MARKED}}} ORDER BY o DESC, i) AS ms FROM w GROUP BY ALL),
r AS (SELECT doc_id, list_reduce(list_prepend({{'o': 0::BIGINT, 'n': 0, 'm': text}}, ms), lambda a, b: {{'o': 0::BIGINT, 'n': 0, 'm': a.m[1:b.o] || b.m || a.m[b.o + b.n + 1:]}}).m AS markdown FROM m)"""


@query(f"""WITH {ENTITIES_SQL} SELECT doc_id, 'offsets' AS form, md5(markdown) AS markdown FROM r UNION ALL SELECT doc_id, 'parts', md5(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '12.5'
 ELSE left(text, 20) || '**' || text[21:30] || '**[there](https://e.org/' || doc_id || ')> a' || chr(10) || '> b!@me' END) FROM documents WHERE length(text) > 100""")
def entities_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with entities by offset, nested and repeated ones too, and messages in parts, as Markdown."""
    d = T.raw(spark, sf_dir, "documents").filter(F.length("text") > 100)
    none = F.lit(None).cast("string")
    entities = F.array(*(F.struct(F.lit(k).alias("type"), F.expr(o).cast("int").alias("offset"), F.expr(n).cast("int").alias("length"), F.concat(F.lit("https://e.org/"), "doc_id").alias("url") if "Url" in k else none.alias("url"), F.lit("py" if "Pre" in k else None).cast("string").alias("language")) for k, o, n in ENTITIES))
    live = d.select("doc_id", F.lit("offsets").alias("form"), F.md5(K.from_offsets(F.col("text"), entities).cast("binary")).alias("markdown"))
    part = lambda kind, text, href=None: F.struct(F.lit(kind).alias("type"), text.alias("text"), (none if href is None else href).alias("href"))
    objects = [part("bold", F.substring("text", 21, 10)), part("text_link", F.lit("there"), F.concat(F.lit("https://e.org/"), "doc_id")), part("blockquote", F.lit("a\nb")), part(None, F.lit("!")), part("mention", F.lit("@me"))]
    json = lambda c: F.to_json(F.struct(c.alias("v")))
    bare = lambda c: F.substring(json(c), F.lit(6), F.length(json(c)) - 6)  # noqa: E731  a JSON value by itself
    listed = F.concat(F.lit("["), bare(F.substring("text", 1, 20)), *(F.concat(F.lit(","), F.to_json(o)) for o in objects), F.lit(",3]"))
    raw = F.when(F.col("doc_id") % 3 == 0, bare(F.col("text"))).when(F.col("doc_id") % 3 == 1, F.lit("12.5")).otherwise(listed)
    exported = d.select("doc_id", F.lit("parts").alias("form"), F.md5(K.from_parts(F.parse_json(raw)).cast("binary")).alias("markdown"))
    return live.unionByName(exported)


#: Segments of videos as they are stored: whole, without a summary, without marks, with loose ones.
SEGMENT = "CASE page_id % 5 WHEN 0 THEN concat('TITLE: ', {t}, chr(10), 'SUMMARY: of page ', page_id, chr(10), '---', chr(10), 'CONTENT:', chr(10), ' ', html) WHEN 1 THEN concat('TITLE:  Page ', page_id, ' ', chr(10), html) WHEN 2 THEN html WHEN 3 THEN concat('SUMMARY: loose ---x', chr(10), 'CONTENT: ', page_id) ELSE concat('a --- b --- ', page_id) END"
TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN trim({TITLE}) WHEN 1 THEN 'Page ' || page_id ELSE 'Untitled Segment' END AS title, CASE page_id % 5 WHEN 0 THEN 'of page ' || page_id WHEN 3 THEN 'loose' ELSE '' END AS summary,
 md5(CASE page_id % 5 WHEN 0 THEN trim(html, E' \\t\\n\\r\\f\\v') WHEN 3 THEN page_id::VARCHAR WHEN 4 THEN page_id::VARCHAR ELSE CASE WHEN contains(html, 'CONTENT:') OR contains(html, '---') OR contains(html, 'TITLE: ') THEN 'other' WHEN page_id % 5 = 1 THEN 'TITLE:  Page ' || page_id || ' ' || chr(10) || html ELSE html END END) AS content_md5 FROM pages""")
def segment_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, summary and content of the text of a video's segment."""
    p = T.raw(spark, sf_dir, "pages").select("page_id", "html", F.expr(SEGMENT.format(t=TITLE)).alias("t"))
    odd = F.col("page_id").cast("int") % 5
    marked = F.contains("html", F.lit("CONTENT:")) | F.contains("html", F.lit("---")) | F.contains("html", F.lit("TITLE: "))
    content = F.when(odd.isin(1, 2) & marked, "other").otherwise(K.segment_content(F.col("t")))
    return p.select("page_id", K.segment_title(F.col("t")).alias("title"), K.segment_summary(F.col("t")).alias("summary"), F.md5(content.cast("binary")).alias("content_md5"))


#: Names in both alphabets, with signs, and without a letter.
NAMES = f"CASE page_id % 4 WHEN 0 THEN {TITLE} WHEN 1 THEN 'Щука & Ёж №' || page_id || ' (юный)' WHEN 2 THEN '  Иван  Петров-' || {TITLE} ELSE '—!' END"


@query(f"SELECT page_id, {X.slug_sql(NAMES)} AS slug FROM pages")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw(spark, sf_dir, "pages").select("page_id", X.slug(F.expr(NAMES)).alias("slug"))


#: Questions in both languages, with what isn't read, and without a letter.
ASKED = "CASE doc_id % 7 WHEN 0 THEN 'see #привет now' WHEN 1 THEN concat(doc_id, ' + 1?') WHEN 2 THEN concat('agents vs RAG — что лучше для ', lang) WHEN 3 THEN concat('@вася https://пример.рф/', doc_id, ' ok') WHEN 4 THEN concat('#', lang, ' http://a.b/c') WHEN 5 THEN '' ELSE text END"


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(q, '[\x{{400}}-\x{{481}}\x{{48A}}-\x{{4FF}}]') THEN 'ru' WHEN regexp_matches(q, '[A-Za-z]') THEN 'en' ELSE 'ru' END AS language
FROM (SELECT doc_id, regexp_replace(coalesce({ASKED}, ''), 'https?://[^ \t\n\r\f\x0B]+|@[\p{{L}}\p{{N}}_]+|#[\p{{L}}\p{{N}}_]+', '', 'g') AS q FROM documents)""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw(spark, sf_dir, "documents").select("doc_id", X.language(F.expr(ASKED)).alias("language"))


FLAT = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({FLAT}) > 120 THEN rtrim(left({FLAT}, 117)) || '...' ELSE {FLAT} END AS excerpt FROM documents")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).select("doc_id", X.clip(F.col("text"), 120).alias("excerpt"))


@query(f"WITH {D} SELECT list_value({', '.join(map(repr, X.MONTHS))})[month(created_at)] || ' ' || year(created_at) AS month, count(*) AS n FROM docs GROUP BY 1")
def month_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.docs(spark, sf_dir).groupBy(X.month_label(F.col("created_at")).alias("month")).agg(F.count("*").alias("n"))


HOST = "regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g'), '^www\\.', '')"


#: Links of every class beside the pages' own.
LINKED = (
    "CASE page_id % 10 WHEN 0 THEN concat('https://github.com/org', page_id, '/repo?tab=x') WHEN 1 THEN concat('HTTPS://me@www.GitHub.com:443/org', page_id, '/') WHEN 2 THEN concat('http://t.me/c/', page_id) WHEN 3 THEN concat('https://www.youtube.com/watch?v=', page_id) "
    "WHEN 4 THEN 'https://youtu.be/x' WHEN 5 THEN 'https://telegram.me' WHEN 6 THEN concat('https://gist.github.com/a/', page_id) WHEN 7 THEN 'https://github.com' ELSE url END"
)


@query(f"""SELECT page_id, {HOST} AS domain, CASE page_id % 10 WHEN 0 THEN 'github_repo' WHEN 1 THEN 'github' WHEN 2 THEN 'telegram_post' WHEN 3 THEN 'video' WHEN 4 THEN 'video' WHEN 5 THEN 'telegram_post' WHEN 7 THEN 'github' ELSE 'web' END AS kind
FROM (SELECT page_id, {LINKED} AS url FROM pages)""")
def link_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.expr(LINKED)
    return T.raw(spark, sf_dir, "pages").select("page_id", X.domain(u).alias("domain"), X.link_kind(u).alias("kind"))


@query("SELECT doc_id, source_id, pos FROM (SELECT doc_id, source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) WHERE pos BETWEEN 11 AND 20")
def offset_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("doc_id")).cast("long")
    return T.docs(spark, sf_dir).select("doc_id", "source_id", place.alias("pos")).filter("pos BETWEEN 11 AND 20")
