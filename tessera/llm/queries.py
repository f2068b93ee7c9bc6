"""The queries of the operators of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, language_id, line_dedup, merkle, minhash, mixing, prefix_trie, sentencepiece_scan, structure_repair, suffix_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || doc_id) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), sorted AS (
  SELECT *, 2.0 * source_size::DOUBLE AS cap, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM sources
), levels AS (
  SELECT k - 1 AS clamped, (1.5 * (SELECT sum(source_size) FROM sources)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, cap, weight
  FROM sorted
), level AS (
  SELECT arg_min(level, clamped) AS level FROM levels WHERE weight * level < cap
), targets AS (
  SELECT source, source_size, least(cap, weight * level)::DOUBLE AS target, round(least(cap, weight * level))::BIGINT AS goal FROM sorted, level
), placed AS (
  SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS repeats, goal,
    sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (repeats * size + greatest(0, least(size, goal - repeats * source_size - (upto - size))))::BIGINT AS taken
FROM placed
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep="none", texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = chat_format.to_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    made = chat_format.render(turns)
    back = made.select("conv_id", "formatted", chat_format.parse_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(5 + 1 + 9 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + length(text)
    + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.delete_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("__lines").cast("long").alias("n_lines"),
        F.col("__removed").cast("long").alias("n_removed"),
        F.col("__spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edits(table(spark, sf_dir, "documents"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = sentencepiece_scan.decode(sentencepiece_scan.encode(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.part(F.col("doc_id")) == 2, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("key", "parent")


def crc32_sql(text: str) -> str:
    """DuckDB's expression of the crc32 of an ASCII text: eight steps a byte."""
    step = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    return f"xor(list_reduce({codes}, lambda crc, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP12_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT conv_id, pos, role, text FROM t JOIN c USING (conv_id) WHERE pos > h
  UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
), l AS (
  SELECT conv_id, pos, md5(length(role) || ':' || role || text) AS label, len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM r
), q AS (
  SELECT c.conv_id, coalesce(list(label ORDER BY pos) FILTER (pos IS NOT NULL), []) AS labels, coalesce(list(words ORDER BY pos) FILTER (pos IS NOT NULL), []) AS words
  FROM c LEFT JOIN l USING (conv_id) GROUP BY 1
), p AS (
  SELECT conv_id, unnest(range(0, len(labels) + 1)) AS depth, labels, words FROM q
), k AS (
  SELECT conv_id, depth, md5(array_to_string(labels[1:depth], ',')) AS key, CASE WHEN depth > 0 THEN md5(array_to_string(labels[1:depth - 1], ',')) END AS parent,
    coalesce(words[depth], 0) AS words, depth = len(labels) AS ends FROM p
), n AS (
  SELECT key, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM k GROUP BY key, depth
), kids AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
below AS (
  SELECT a.key, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (kids.key IS NULL) AS n_leaves
  FROM n LEFT JOIN kids ON kids.key = n.key JOIN k a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n up ON up.key = n.parent LEFT JOIN kids ON kids.key = n.key JOIN below ON below.key = n.key
"""


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair(table(spark, sf_dir, "conversations"))


OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("conv_id || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations WHERE conv_id IS NOT NULL
), e AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM d WHERE kind <> 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e
), s AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM p
), f AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    coalesce(before || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM s
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(pos) AS n FROM f GROUP BY conv_id
), grammar(state, want, name, next) AS (VALUES (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
added(state, names, next) AS (
  SELECT state, []::VARCHAR[], state FROM grammar UNION ALL SELECT state, [name || ':'], next FROM grammar
  UNION ALL SELECT g.state, [g.name || ':', h.name || ':'], h.next FROM grammar g JOIN grammar h ON h.state = g.next
), edits AS (
  SELECT f.conv_id, f.pos, g.state, x.* FROM f, grammar g, LATERAL (
    SELECT 'D' AS edit, 3 AS cost, []::VARCHAR[] AS line, g.state AS mid
    UNION ALL SELECT 'R', 2 + f.truncated::INT, [g.name || ':' || f.text], g.next WHERE NOT f.blank AND NOT f.duplicate
    UNION ALL SELECT 'K', f.truncated::INT, [f.role || ':' || f.text], g.next WHERE NOT f.blank AND NOT f.duplicate AND f.initial = g.want
    UNION ALL SELECT 'K', f.truncated::INT, [f.role || ':' || f.text], 1 WHERE NOT f.blank AND NOT f.duplicate AND f.initial = 's' AND g.state = 0
  ) x
), walk(conv_id, pos, state, best) AS (
  SELECT conv_id, 0::BIGINT, next, {{'cost': 2 * len(names), 'audit': repeat('I', len(names)), 'lines': names}} FROM counts, added WHERE state = 0
  UNION ALL
  SELECT w.conv_id, e.pos, a.next, min({{'cost': w.best.cost + e.cost + 2 * len(a.names), 'audit': w.best.audit || e.edit || repeat('I', len(a.names)), 'lines': w.best.lines || e.line || a.names}})
  FROM walk w JOIN edits e ON e.conv_id = w.conv_id AND e.pos = w.pos + 1 AND e.state = w.state JOIN added a ON a.state = e.mid GROUP BY ALL
), ended AS (
  SELECT conv_id, min(best) AS best FROM walk JOIN counts USING (conv_id) WHERE pos = n AND state IN (0, 3) GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) i LEFT JOIN counts USING (conv_id) LEFT JOIN ended USING (conv_id)
"""


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_mixing, op2_suffix_dedup, op3_chat_format, op4_line_dedup, op5_warc, op6_merkle, op7_sentencepiece, op8_hnsw, op9_toxicity, op10_minhash,
            op11_language_id, op12_prefix_trie, op13_structure_repair,
        )
    }  # fmt: skip


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op3_chat_format": OP3_SQL, "op5_warc": OP5_SQL, "op12_prefix_trie": OP12_SQL, "op13_structure_repair": OP13_SQL}
