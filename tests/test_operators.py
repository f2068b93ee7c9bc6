import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import comments as C
from tessera.operators import community as Q
from tessera.operators import corpus as K
from tessera.operators import evidence as V
from tessera.operators import funnel as P
from tessera.operators import maintenance as M
from tessera.operators import matrix as X
from tessera.operators import passports as Z
from tessera.operators import video as H
from tessera.operators.numbering import numbered
from tessera.sources import exports as E
from tessera.sources.shared import shared_path
from tessera.streaming import jobs


def test_neighbours_both_ways_and_parents(spark):
    docs = spark.createDataFrame([(i, "s" if i < 9 else "t", None) for i in range(12)], "doc_id long, source_id string, created_at timestamp_ntz")
    links = spark.createDataFrame([(1, 3, "x"), (4, 1, "x"), (2, 3, "x"), (1, 2, "x"), (1, 10, "x")], "src long, dst long, kind string")
    got = {r.doc_id: (list(r.parents), r.parent) for r in P.neighbours(docs.filter("doc_id IN (1, 2)"), links, docs).collect()}
    assert got == {3: ([1, 2], None), 4: ([1], 1)}


def test_scores_missing_and_unknown(spark):
    answers = spark.createDataFrame([("=== POST 1 ===\nID: 5\nScore: 0.9\nReason: good\n=== POST 2 ===\nID: 77\nScore: 1\n",)], "answer string")
    docs = spark.createDataFrame([(5,), (6,)], "doc_id long")
    assert {tuple(r) for r in P.parsed_scores(answers, docs).collect()} == {(5, 0.9, "good"), (6, 0.0, "")}


def test_roots_are_texts_at_the_end_of_chains(spark):
    rows = [(1, None, True), (2, 1, False), (3, 2, False), (4, 3, True), (5, 4, False), (6, 99, False), (7, 6, False), (8, None, False), (9, 8, True)]
    got = {r.id: r.root for r in M.roots(spark.createDataFrame(rows, "id long, parent long, is_text boolean")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 8, 9: 9}


def test_roots_of_long_chains_and_ways_into_cycles(spark):
    chain = [(i, i - 1 if i else None, i == 0) for i in range(300)]
    cycles = [(1000, 1001, False), (1001, 1000, False), (1002, 1000, False), (1003, 1003, False), (1004, 1003, False)]
    got = {r.id: r.root for r in M.roots(spark.createDataFrame(chain + cycles, "id long, parent long, is_text boolean")).collect()}
    assert got == {i: 0 for i in range(300)} | {i: i for i in range(1000, 1005)}


def test_orphans_keep_null_keys(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1,), (None,)], "p long")
    assert {r.k for r in M.orphans(child, "k", parent, "p").collect()} == {2, None}


def test_author_sides_with_nulls(spark):
    posts = spark.createDataFrame([(1, "channel7"), (2, None)], "doc_id long, post_author string")
    said = spark.createDataFrame([(1, 1, "7"), (1, 2, "8"), (1, 3, None), (2, 4, "7")], "doc_id long, comment_id long, author_id string")
    assert {r.comment_id: r.side for r in C.by_author(said, posts).collect()} == {1: "author", 2: "community", 3: None, 4: "community"}


@pytest.mark.parametrize("text, n", [('[{"topic":"a"}]', 1), ('{"drift_topics":[{"topic":"a"},{"topic":"b"}]}', 2), ('{"drift_topics":{"drift_topics":[{"topic":"a"}]}}', 1), ("broken", None), (None, None)])
def test_topics(spark, text, n):
    got = spark.createDataFrame([(text,)], "t string").select(C.parsed_topics(F.col("t")).alias("t")).first().t
    assert (None if got is None else len(got)) == n


def test_normalised_rejects_bad_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([None, 1.0],)], "v array<double>")
    got = [r.u for r in rows.select(C.normalised(F.col("v")).alias("u")).collect()]
    assert got == [[0.6, 0.8], None, None, None]


def test_representatives_prefer_new_areas(spark):
    rows = [("s", 1, 100, ["a"]), ("s", 2, 90, ["a"]), ("s", 3, 10, ["b"]), ("s", 4, 80, ["a"])]
    got = K.representatives(spark.createDataFrame(rows, "source_id string, doc_id long, n int, labels array<string>"), 3).orderBy("pos").collect()
    assert [r.doc_id for r in got] == [1, 3, 2]


def test_impact_cascade(spark):
    kind = "name string, score double, role string, confidence double, refs int, flags int, exact boolean, exact_coverage string, exact_best double, related boolean"
    rows = [
        ("noise", 3.0, "primary", 0.9, 1, 0, False, "none", 0.0, False), ("low confidence", 4.5, "primary", 0.3, 1, 0, False, "none", 0.0, False), ("no refs", 4.5, "primary", 0.9, 0, 0, False, "none", 0.0, False),
        ("flagged", 4.5, "primary", 0.9, 1, 1, True, "thin", 1.0, True), ("deeper", 4.5, "primary", 0.9, 1, 0, True, "thin", 4.6, True), ("duplicate", 4.5, "primary", 0.9, 1, 0, True, "strong_multi_source", 4.6, True),
        ("adjacent", 4.5, "primary", 0.9, 1, 0, False, "none", 0.0, True), ("gap", 4.5, "primary", 0.9, 1, 0, False, "none", 0.0, False), ("weak area", 3.5, "secondary", 0.9, 1, 0, False, "none", 0.0, False),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r.name: r.c for r in df.select("name", X.impact(df).alias("c")).collect()}
    assert list(got.values()) == ["noise_risk", "needs_probe", "needs_probe", "taxonomy_extension", "deepens_existing_cell", "likely_duplicate", "adds_adjacent_viewpoint", "fills_gap", "needs_probe"]


def test_rollups_count_a_contribution_once_for_its_domain(spark):
    kind = "source_id string, domain string, intents array<string>, cell_id string, intent string, score double, role string, confidence double"
    rows = [("a", "d", ["x", "y"], "c1", "x", 4.5, "primary", 0.5), ("b", "d", ["y"], "c2", "y", 4.4, "primary", 0.5)]
    got = {(r.kind, r.rollup_id): (r.contributions, r.sources, r.overlap) for r in X.rollups(spark.createDataFrame(rows, kind)).collect()}
    assert got[("domain", "d")] == (2, 2, "related_multi_source")
    assert got[("intent", "x")] == (1, 1, "single_source")


def test_fuzzy_unique_as_a_scan(spark):
    rng = random.Random(3)
    titles = ["How to fix X?", "how to FIX x", "the of", "", "Memory leak in v2.1", "memory leak in v2.1 again and again", "Ü ü"]
    rows = [(i, i, rng.choice(["http://a/1?q=2", "http://a/1/", "http://a/2", "http://b", None, ""]), rng.choice(titles)) for i in range(60)]
    seen, want = set(), set()
    for i, _, url, title in rows:
        words = [w for w in re.findall(r"[a-z0-9_+#.-]{2,}", title.lower()) if w not in Q.STOPWORDS]
        keys = {("u", (url or "").split("?")[0].rstrip("/")), ("t", re.sub("[^a-z0-9]", "", title.lower()))} | ({("s", " ".join(words[:8]))} if words else set())
        if not keys & seen:
            seen |= keys
            want.add(i)
    posts = spark.createDataFrame(rows, "post_id long, pos long, url string, title string")
    assert {r.post_id for r in Q.fuzzy_unique(posts).collect()} == want
    # A post that only shares a key with one that went stays.
    chain = spark.createDataFrame([(1, 1, "u1", "one"), (2, 2, "u1", "two"), (3, 3, "u3", "two"), (4, 4, "u3", "four")], "post_id long, pos long, url string, title string")
    assert {r.post_id for r in Q.fuzzy_unique(chain).collect()} == {1, 3}
    assert Q.fuzzy_unique(posts.limit(0)).count() == 0


def states(events: list, failures: int = 5, seconds: int = 30) -> dict:
    """The circuit breaker as a plain scan of one user's events (time, id, kind)."""
    errors, opened, is_open, out = 0, 0, False, {}
    for at, i, kind in sorted(events):
        said = "closed" if not is_open else "half-open" if at - opened >= seconds else "open"
        if said != "open":
            errors = errors + 1 if kind == "error" else 0
            if kind == "error" and (said == "half-open" or errors >= failures):
                is_open, opened = True, at
            elif kind != "error":
                is_open = False
        out[i] = said
    return out


@pytest.mark.parametrize("rows", [7, 10_000])
def test_circuit_breaker_as_a_scan_whatever_the_batches(spark, rows):
    rng = random.Random(1)
    events = {u: [(1_700_000_000 + k * rng.choice([1, 3, 9]), u * 1000 + k, rng.choice(["error", "error", "error", "view"])) for k in range(200)] for u in range(3)}
    flat = [(i, at, u, kind) for u, own in events.items() for at, i, kind in own][::-1]  # newest first
    folder = shared_path(spark, "breaker")
    df = spark.createDataFrame(flat, "event_id long, at long, user_id long, event_type string").select("event_id", F.timestamp_seconds("at").alias("ts"), "user_id", "event_type", F.lit(0.0).alias("value"))
    df.coalesce(1).write.parquet(f"{folder}/in")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        got = {r.event_id: r.state for r in jobs.run_once(jobs.breaker(jobs.event_stream(spark, f"{folder}/in")), "breaker", folder).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {k: v for own in events.values() for k, v in states(own).items()}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_numbered_in_buckets(spark, width):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i) for i in rng.sample(range(500), 200)]
    got = {(r.source, r.id): (r.n, r.size) for r in numbered(spark.createDataFrame(rows, "source string, id long"), "source", [F.col("id")], F.floor(F.col("id") / width), "n", "size").collect()}
    for source in ("a", "b", None):
        own = sorted(i for s, i in rows if s == source)
        assert {i: got[source, i] for i in own} == {i: (k, len(own)) for k, i in enumerate(own, 1)}


def test_tree_of_comments(spark):
    rows = [(1, 1, None, "ann", "question\nmore", 5), (1, 2, 1, "bob", "answer &lt;b&gt;", 4), (1, 3, 2, "ann", "Thanks!", 1), (1, 4, 3, "x", "deep", 1), (1, 5, 4, "x", "too deep", 1), (1, 6, None, "y", "", 0), (1, 7, 6, "y", "hangs on nothing", 0), (1, 8, None, "z", "last", 2)]
    c = spark.createDataFrame(rows, "post_id long, comment_id long, parent_id long, author string, body string, score long").withColumn("post_author", F.lit("ann"))
    r = Q.rendered(Q.tree_lines(c)).first()
    assert (r.n, r.depth, r.verified) == (5, 3, 1)
    assert r.tree.split("\n") == ["  1. [OP] [ann | Score: 5]: question", "     more", "    └─ [VERIFIED] [bob | Score: 4]: answer <b>", "      └─ [OP] [ann | Score: 1]: Thanks!", "        └─ [x | Score: 1]: deep", "  3. [z | Score: 2]: last"]


def test_a_failed_chunk_is_tried_again_and_loses_nothing_else(spark):
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).coalesce(1)

    def scorer(batch):
        if 55 in set(batch["doc_id"]):
            raise ValueError("no answer")
        return P.threshold_scorer(batch)

    got = {r.doc_id: (r.relevance, r.error) for r in P.map_scores(docs, scorer, size=50, cooldown=0).collect()}
    assert len(got) == 120 and {i for i, (_, e) in got.items() if e} == set(range(50, 100)) and got[0] == ("LOW", None)


def test_failed_chunks_wait_until_the_others_are_done(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], i // 20, "t") for i in range(100)], "doc_id long, source_id string, chunk long, text string").coalesce(1)
    seen = []

    def scorer(batch):
        (key,) = set(zip(batch["source_id"], batch["chunk"], strict=True))
        seen.append(key)
        if key in (("a", 0), ("b", 2)) and (seen.count(key) == 1 or key[0] == "b"):
            raise ValueError(f"call {len(seen)}")
        return P.threshold_scorer(batch).assign(reason=f"call {len(seen)}")

    got = P.map_scores(docs.repartition(1), scorer, cooldown=0.01, by=["source_id", "chunk"]).collect()
    by = {r.doc_id: (r.reason, r.error) for r in got}
    assert len(got) == len(by) == 100 and {i for i, (_, e) in by.items() if e} == set(range(41, 60, 2))
    calls = {i: int((r or e).split()[1]) for i, (r, e) in by.items()}
    assert len({calls[i] for i in range(0, 20, 2)}) == 1


@pytest.mark.parametrize("threads", [True, False])
def test_packets_of_posts_and_comments(spark, threads):
    rows = [(1, "message", "2024-01-02", "post", None), (2, "message", "2024-01-03", "reply", 1), (3, "service", "2024-01-03", "x", None), (4, "message", "2024-01-03", "to a service", 3), (5, "message", "2023-01-01", "old", None), (6, "message", "2024-01-04", "to an old one", 5), (7, "message", "2024-01-05", "", 2), (8, "message", "2024-01-05", "deep", 7), (9, "message", "2024-01-05", "cut", None), (10, "message", "2024-01-05", "on a cut one", 9)]
    folder = shared_path(spark, "chat")
    spark.createDataFrame([(json.dumps({"id": 1, "messages": [{"id": i, "type": k, "date": d + "T01:02:03", "from": "me", "text": t} | ({"reply_to_message_id": r} if r else {}) for i, k, d, t, r in rows]}),)], "v string").write.text(folder)
    got = {r.ext_id: (r.source_ref, r.post_ref) for r in E.packet(E.chat_entries(spark, folder), "2024-01-01", "2024-01-31", 3, threads).collect()}
    if threads:
        assert got == {1: ("P0001", "P0001"), 2: ("P0001.C0001", "P0001"), 4: ("P0002", "P0002"), 6: ("P0003", "P0003"), 8: ("P0001.C0002", "P0001")}
    else:
        assert got == {1: ("P0001", "P0001"), 2: ("P0002", "P0002"), 4: ("P0003", "P0003")}


def test_results_stay_until_the_new_one_is_there(spark):
    folder = shared_path(spark, "results")
    E.write_result(spark.range(3), folder, "r")
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        E.write_result(bad, folder, "r")
    assert E.read_result(spark, folder, "r").count() == 3
    path = E.write_result(spark.range(5), folder, "r")
    assert E.read_result(spark, folder, "r").count() == spark.read.json(path).count() == 5
    with pytest.raises(ValueError):
        E.write_result(spark.range(1), folder, "../r")


def test_questions_with_variants_and_negatives(spark):
    variants = {"tts": ["text to speech", "TTS"], "k8s": ["kubernetes"], "docker": ["docker", "containers"], "vector": ["embedding"]}
    asked = ["TTS engines", "best tts tts", "mtts", "Docker and VECTOR docker", "docker -docker k8s", "a -b c -docker", "nothing", "", None]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    got = [r.x for r in rows.select("i", Q.expanded_variants(F.col("q"), variants).alias("x")).orderBy("i").collect()]
    assert got == ['("text to speech" OR "TTS") engines', '("text to speech" OR "TTS") best  tts', "mtts", '("docker" OR "containers") ("embedding") and  docker', '("kubernetes") docker   -docker'.replace("docker   -", "docker -"), "a -b c -docker", "nothing", "", None]


def test_ids_of_hashes_are_of_all_bits(spark):
    rows = spark.createDataFrame([("http://x_1",), ("é",), ("",)], "t string").select("t", E.hash_id(F.col("t")).alias("h")).collect()
    assert all(r.h == int(hashlib.md5(r.t.encode()).hexdigest(), 16) % 10**9 for r in rows)


def test_segments_of_a_won_topic(spark):
    rows = [(1, "v", "a", 30, "x" * 500, "full 1"), (2, "v", "a", 10, "short", "full 2"), (3, "v", "b", 20, "y" * 200, "full 3"), (4, "v", "c", 5, "z", "full 4"), (5, "w", "a", 1, "s", "full 5")]
    out = H.resolved(H.mapped(spark.createDataFrame(rows, "doc_id long, video_id string, topic string, seconds long, summary string, text string"))).collect()
    assert sorted((r.video_id, r.place, r.doc_id, r.relevance, r.content[:6]) for r in out) == [("v", 1, 2, "MEDIUM", "short"), ("v", 2, 3, "MEDIUM", "yyyyyy"), ("v", 3, 1, "HIGH", "full 1")]


def test_marks_never_go_back(spark):
    docs = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(1, 9)], "doc_id long, source_id string")
    state = M.advanced(None, docs.filter("doc_id <= 3"))
    new = M.above(docs, state, 2)
    assert {r.doc_id: r.batch for r in new.collect()} == {4: 0, 5: 0, 6: 0, 7: 0, 8: 1}
    after = M.advanced(state, new)
    assert {tuple(r) for r in after.collect()} == {("a", 5, 5), ("b", 8, 3)}
    assert M.above(docs, after, 2).count() == 0 and {tuple(r) for r in M.advanced(after, docs.limit(0)).collect()} == {("a", 5, 5), ("b", 8, 3)}


def test_topics_are_mended_and_unnested(spark):
    rows = [(1, '{"drift_topics":{"drift_topics":[{"topic":"a"}]}}'), (2, '{drift_topics:[{topic:"b"}]}'), (3, r'[{"topic":"c\d"}]'), (4, "no"), (5, None), (6, "[]")]
    got = {r.id: (r.u, r.t) for r in spark.createDataFrame(rows, "id long, j string").select("id", C.unnested(F.col("j")).alias("u"), F.transform(C.parsed_topics(F.col("j")), lambda t: t["topic"]).alias("t")).collect()}
    assert got[1] == ('{"drift_topics":[{"topic":"a"}]}', ["a"])
    assert [got[i][1] for i in (2, 3, 4, 5, 6)] == [["b"], ["cd"], None, None, []]
    assert (got[4][0], got[5][0]) == ("no", None)


def test_groups_go_by_cutoff_and_exclusion(spark):
    groups = spark.createDataFrame([(1, True, "[]"), (2, False, "[]"), (3, True, None), (4, True, "[]"), (9, True, "[]")], "doc_id long, drifted boolean, topics string")
    posts = spark.createDataFrame([(i, f"202{i}-01-01") for i in (1, 2, 3, 4)], "doc_id long, d string").select("doc_id", F.col("d").cast("timestamp_ntz").alias("created_at"))
    comments = spark.createDataFrame([(3,), (3,)], "doc_id long")
    got = {tuple(r) for r in C.thread_groups(groups, posts, comments, "2022-01-01", spark.createDataFrame([(4,), (4,)], "doc_id long")).selectExpr("doc_id", "size(topics)", "n_comments").collect()}
    assert got == {(3, 0, 2)}


def test_one_group_without_vector_sends_its_source_to_the_texts(spark):
    rows = [(1, "a", [1.0, 0.0], "x"), (2, "a", [0.0, 1.0], "x"), (3, "b", [1.0, 0.0], "x"), (4, "b", None, "x y"), (5, "b", None, "z")]
    found = C.dispatched(spark.createDataFrame(rows, "group_id long, source_id string, embedding array<double>, text string"), [1.0, 0.0], lambda t: F.contains(t, F.lit("x")).cast("int"))
    assert {tuple(r) for r in found.collect()} == {("a", 1, "vectors", 1.0), ("b", 3, "texts", 1.0), ("b", 4, "texts", 1.0)}


def test_signals_fall_back_to_what_was_selected(spark):
    kind = "id long, raw array<struct<claim:string,support_level:string,supporting_sources:array<string>>>, refs array<struct<source_key:string,reason:string>>"
    refs = [("s:1", None), ("s:2", "why")]
    rows = [(1, [(" c ", "direct", ["s:2", "no"]), (None, "weak", []), ("d", None, None)], refs), (2, [("  ", "weak", [])], refs), (3, None, []), (4, [("e", "odd", [])], None)]
    got = {r.id: [tuple(s) for s in r.s] if r.s is not None else None for r in spark.createDataFrame(rows, kind).select("id", V.signals(F.col("raw"), F.col("refs"), 2).alias("s")).collect()}
    assert got == {1: [("c", "direct", ["s:2"]), ("d", "unknown", None)], 2: [("s:1", "direct", ["s:1"]), ("why", "direct", ["s:2"])], 3: [], 4: [("e", "unknown", [])]}


def test_keys_of_results_are_where_they_come_first(spark):
    key = "array<struct<source_key:string>>"
    kind = f"request_id long, sources array<struct<expert_id:string,source_key:string>>, experts array<struct<expert_id:string,main_sources:{key},digest:struct<source_refs:{key},source_index:{key}>>>"
    rows = [(1, [("a", "k1"), ("a", None)], [("b", [("k1",), ("k2",)], ([("k3",)], None)), (None, None, None)]), (2, None, None)]
    results = spark.createDataFrame(rows, kind)
    assert {tuple(r) for r in V.artifact_sources(results).collect()} == {(1, "k1", "a", 0), (1, "k2", "b", 3), (1, "k3", "b", 4)}
    assert {(r.request_id, tuple(r.experts), r.expert_count, r.source_keys_count) for r in V.artifact_manifest(results).collect()} == {(1, ("b",), 1, 3), (2, (), 0, 0)}


def test_digest_shows_the_first_and_counts_the_rest(spark):
    index = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, None), ("b", 4, 1)], "source_id string, doc_id long, place int")
    comments = spark.createDataFrame([(1,), (1,), (1,), (3,)], "doc_id long")
    links = spark.createDataFrame([(2,), (3,)], "src long")
    got = V.digest_counts(index, comments, links, 2, 2).select("source_id", "sources", "shown", "omitted", "comments", "shown_comments", "omitted_comments", "links").collect()
    assert {tuple(r) for r in got} == {("a", 3, 2, 1, 3, 2, 1, 1), ("b", 1, 1, 0, 0, 0, 0, 0)}


def test_groups_of_a_question(spark):
    places = {"ai": ["x", "y", "x"], "chat": ["z", "x"]}
    rows = spark.createDataFrame([(1, "AI chat z"), (2, "other"), (3, None)], "id long, text string").withColumn("g", Q.picked(F.col("text"), places, ["general"], 3))
    got = {r.id: (list(r.g), list(r.s)) for r in rows.select("id", "g", Q.soft_targets(F.col("g"), F.array(F.lit("z")), F.split(F.lower(F.coalesce("text", F.lit(""))), " "), ["x"]).alias("s")).collect()}
    assert got == {1: (["x", "y", "z"], ["z", "y"]), 2: (["general"], ["general"]), 3: (["general"], ["general"])}


def test_tiers_keep_all_posts(spark):
    rows = [(1, 5.0, 0.1), (2, 5.0, 0.9), (3, 4.0, None), (4, 4.0, 1.0), (5, None, 1.0)]
    got = {r.post_id: (r.tier, r.place) for r in Q.tiered(spark.createDataFrame(rows, "post_id long, score double, ai double"), 3).collect()}
    assert got == {2: (1, 1), 3: (1, 2), 1: (1, 3), 4: (2, None), 5: (2, None)}


def test_the_contract_of_passports(spark):
    cells = spark.createDataFrame([("a", "c1", "strong", 5.0, ["P1"]), ("a", "c2", "signature", 3.0, ["P9"]), ("a", "c3", "strong", 1.0, []), ("a", "c4", "weak", 1.0, ["P1"]), ("b", "c1", "normal", None, None)], "source_id string, cell_id string, weight string, depth double, refs array<string>")
    exported = cells.filter("source_id = 'a' AND cell_id = 'c1'")
    index = spark.createDataFrame([("a", "P1")], "source_id string, ref string")
    got = {tuple(r) for r in X.contract(cells, exported, index, ["depth"]).select("source_id", "cells", "incomplete", "exported", "missing_export", "unknown_refs", "valid").collect()}
    assert got == {("a", 4, 0, 1, 2, 1, False), ("b", 1, 1, 0, 0, 0, False)}
    assert {r.cell_id for r in X.not_exported(cells, exported).collect()} == {"c2", "c3"}


def test_passports_of_any_shape_get_what_they_lack(spark):
    cell = lambda sub, weight, refs, **more: {"domain_id": "d", "subdomain_id": sub, "query_intent_ids": ["i", "j"], "recommended_matrix_weight": weight, "evidence_refs": refs} | more
    passports = {
        "a": {
            "matrix_cells": [cell("s1", "strong", ["P0001"]), cell("s2", " Signature ", ["P0002"], depth_score_0_5=4.6), cell("s2", "strong", ["P0002"]), cell("s3", "strong", []), cell("s4", "weak", ["P0001"]), cell(None, "strong", ["P0001"])],
            "matrix_export": {"cells": [cell("s1", "strong", ["P0001"])], "version": 7}, "source_ref_index_used": [{"source_ref": "P0001", "kept": True}],
            "deep": [[[{"x": {"y": ["no P0003", "P0003", {"P0009": "P0004.C0001"}]}}]], "P00011", None, 5],
        },
        "b": {"only": "P0001"}, "c": {},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in passports.items()], "source_id string, p string").select("source_id", F.parse_json("p").alias("passport"))
    index = spark.createDataFrame([("a", r, i) for i, r in enumerate(("P0001", "P0002", "P0003", "P0004.C0001", "P0007"))], "source_id string, ref string, post_id long")
    assert {(r.source_id, r.ref) for r in Z.refs_in(rows).collect()} == {("a", x) for x in ("P0001", "P0002", "P0003", "P0004.C0001")} | {("b", "P0001")}
    got = {r.source_id: (json.loads(r.p), r.repaired, r.skipped) for r in Z.normalized(rows, index).select("source_id", F.to_json("passport").alias("p"), "repaired", "skipped").collect()}
    a, repaired, skipped = got["a"]
    assert [e["source_ref"] for e in a["source_ref_index_used"]] == ["P0001", "P0002", "P0003", "P0004.C0001"] and a["source_ref_index_used"][0] == {"source_ref": "P0001", "kept": True} and a["source_ref_index_used"][3]["post_id"] == 3
    assert (repaired, skipped) == (["d/s2/i"], ["d/s3/i", "missing_required_identity"]) and a["matrix_export"]["version"] == 7 and a["deep"] == passports["a"]["deep"]
    new = a["matrix_export"]["cells"][1]
    assert a["matrix_export"]["cells"][0] == passports["a"]["matrix_export"]["cells"][0] and (new["cell_id"], new["coverage_level"], new["source_role"], new["depth_level"], new["scores"]["depth"]) == ("d/s2/i", "strong", "primary", "deep_practitioner", 4.6)
    assert got["b"][0]["source_ref_index_used"] == [] and got["c"][1:] == ([], [])


def test_only_new_sources_with_documents_are_added(spark):
    candidates = spark.createDataFrame([("a", 1), ("b", 2), ("b", None), ("c", 0), ("Bad", 5), (None, 5), ("d", None)], "source_id string, n_docs long")
    known = spark.createDataFrame([("a",), ("a",), (None,)], "source_id string")
    assert {tuple(r) for r in M.admitted(candidates, known).collect()} == {("a", "exists"), ("b", "added"), ("c", "empty"), ("Bad", "bad id"), (None, "bad id"), ("d", "empty")}
