"""Stores of versioned tables, and what stands on them: the text index, ingest, pruning, replicas, new sources; the work queue; age limits of files."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import publishing as P
from tessera.operators import retrieval as R
from tessera.operators import text_index
from tessera.operators.text_index import TextIndex, followed
from tessera.sources import retention
from tessera.sources.shared import shared_path
from tessera.sources.store import Conflict, Files, Store
from tessera.sources.tables import catalogued, counted, tables_in
from tessera.streaming import jobs
from tessera.streaming import queue as W
from tessera.streaming.ingest import Ingest


@pytest.fixture
def store(spark):
    return Store(spark, shared_path(spark, "store"))


def ids(df, column="doc_id"):
    return sorted(r[column] for r in df.select(column).collect())


def table(spark, values, kind="doc_id long"):
    return spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], kind)


# Versions.


def test_versions_append_replace_and_roll_back(spark, store):
    assert store.manifest()["version"] == 0 and not store.has("a")
    store.publish(replace={"a": table(spark, [1, 2]), "b": table(spark, [7])})
    store.publish(append={"a": table(spark, [3])}, info={"n": 1})
    assert ids(store.read("a")) == [1, 2, 3] and ids(store.read("a", 1)) == [1, 2] and ids(store.read("b")) == [7] and store.manifest()["info"] == {"n": 1}
    store.publish(replace={"a": table(spark, [])}, drop=("b",))
    assert ids(store.read("a")) == [] and not store.has("b")
    assert store.rollback(2) == 4 and ids(store.read("a")) == [1, 2, 3] and ids(store.read("b")) == [7]
    assert store.vacuum() == 1 and store.versions() == [4] and ids(store.read("a")) == [1, 2, 3]


def test_what_fails_halfway_leaves_all_tables(spark, store):
    store.publish(replace={"a": table(spark, [1]), "b": table(spark, [2])})
    broken = table(spark, [5]).withColumn("doc_id", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.publish(replace={"a": table(spark, [9]), "b": broken})

    def verify(made):
        raise ValueError("not so")

    with pytest.raises(ValueError, match="not so"):
        store.publish(replace={"a": table(spark, [9])}, verify=verify)
    assert ids(store.read("a")) == [1] and ids(store.read("b")) == [2] and store.versions() == [1]
    assert len(store.files.names(f"{store.folder}/data")) == 1


def test_of_two_writers_the_later_fails(spark, store):
    store.publish(replace={"a": table(spark, [1])})
    base = store.manifest()["version"]
    store.publish(append={"a": table(spark, [2])}, base=base)
    with pytest.raises(Conflict):
        store.publish(append={"a": table(spark, [3])}, base=base)
    assert ids(store.read("a")) == [1, 2]
    # A writer that died after its claim doesn't stop the next one.
    store.files.create(f"{store.folder}/versions/{store.versions()[-1] + 1:012d}.claim")
    store.publish(append={"a": table(spark, [4])})
    assert ids(store.read("a")) == [1, 2, 4]


# The index.

DOC = "doc_id long, source_id string, created_at timestamp_ntz, text string"
SAID = ["the quick brown fox and the lazy dog", "brown bread with quick butter today", "nothing to be seen of any animal here", "a fox is a fox is a fox, they say", "Ёлка и йод, quick brown words again"]


def docs_of(spark, rows):
    made = [(i, s, "2025-01-01 00:00:00" if i and i % 2 else None, t) for i, s, t in rows]
    return spark.createDataFrame(made, "doc_id long, source_id string, created_at string, text string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def scores(docs, index, expression='fox OR "quick brown" OR br*'):
    return {r.doc_id: r.score for r in R.bm25(docs, R.parsed(expression), index).collect()}


def same(docs, index):
    for expression in ('fox OR "quick brown" OR br*', 'lazy OR nowhere OR "fox is" OR йод'):
        a, b = scores(docs, None, expression), scores(docs, index, expression)
        assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a), expression


def test_index_follows_inserts_updates_and_deletes(spark, store, monkeypatch):
    monkeypatch.setattr(text_index, "MOST", 3)
    rng, index = random.Random(1), TextIndex(store)
    rows = {i: ("s", SAID[i % 5] + f" {i}") for i in range(16)}
    now = lambda: docs_of(spark, [(i, s, t) for i, (s, t) in rows.items()])
    assert index.follow(now()) == "built" and index.follow(now()) == "as it was"
    said = []
    for step in range(4):
        for i in rng.sample(sorted(rows), 3):
            rows[i] = ("s", f"{SAID[(i + step) % 5]} again {step}")
        rows.pop(min(rows))
        rows[100 + step] = ("t", f"fox number {step} of the quick brown ones")
        rows[200] = ("t", "short" if step % 2 else "a long enough text of one fox or another")
        said.append(index.follow(now()))
        same(now(), index.index())
    assert said[0] == "changed" and "merged" in said
    assert set(ids(index.seen())) == {i for i, (_, t) in rows.items() if len(t) > R.MIN_LENGTH}


def test_index_changes_read_no_other_document(spark, store):
    index = TextIndex(store)
    index.build(docs_of(spark, [(i, "s", t) for i, t in enumerate(SAID)]))
    index.upsert(docs_of(spark, [(1, "s", "the fox is now in this document"), (9, "t", "another brown document with a fox")]))
    index.delete(table(spark, [3, 77]))
    left = docs_of(spark, [(0, "s", SAID[0]), (1, "s", "the fox is now in this document"), (2, "s", SAID[2]), (4, "s", SAID[4]), (9, "t", "another brown document with a fox")])
    same(left, index.index())
    assert len(store.segments("postings")) == 3
    index.merge()
    same(left, index.index())
    assert len(store.segments("postings")) == 1 and not store.has("dead")


def test_index_of_a_file_that_is_rewritten_in_place(spark):
    path, folder = shared_path(spark, "docs"), shared_path(spark, "index")
    docs_of(spark, [(i, "s", t) for i, t in enumerate(SAID)]).coalesce(1).write.parquet(path)
    name = spark.read.parquet(path).inputFiles()[0]
    same(spark.read.parquet(path), followed(spark.read.parquet(path), folder).index())
    other = shared_path(spark, "docs")
    docs_of(spark, [(i, "s", t.replace("fox", "cow")) for i, t in enumerate(SAID)] + [(8, "s", SAID[0])]).coalesce(1).write.parquet(other)
    files = Files(spark, path)
    files.fs.delete(files.at(name), False)
    files.fs.rename(files.at(spark.read.parquet(other).inputFiles()[0]), files.at(name))
    again = spark.read.schema(DOC).parquet(path)
    index = followed(again, folder)
    same(again, index.index())
    assert index.store.manifest()["info"]["seg"] == 2 and followed(again, folder).store.versions() == index.store.versions()


def test_index_of_repeated_ids_odd_texts_and_nothing(spark, store):
    rows = [(1, "s", SAID[0]), (1, "s", SAID[0]), (2, None, SAID[3] * 3000), (None, "s", SAID[1]), (3, "s", None), (4, "s", "!" * 50)]
    index = TextIndex(store)
    index.build(docs_of(spark, rows))
    assert index.store.manifest()["info"]["N"] == 4
    assert set(scores(docs_of(spark, rows), index.index())) == {1, 2}
    assert index.follow(docs_of(spark, [])) == "changed" and scores(docs_of(spark, []), index.index()) == {}


def test_index_of_more_documents_than_a_task_takes_at_once(spark, store):
    rows = [(i, "s", "!" * 50 if i % 7 == 0 else f"{SAID[i % 5]} {i}") for i in range(text_index.TOGETHER + 100)]
    docs = docs_of(spark, rows).coalesce(1)
    index = TextIndex(store)
    index.build(docs)
    same(docs, index.index())
    words = {w for _, _, t in rows for w in re.findall(r"\w+", t.lower())}
    assert {r.term for r in index.index().postings.select("term").distinct().collect()} == words


def test_the_tasks_of_an_index_are_as_many_as_its_postings_ask_for(spark, store, monkeypatch):
    monkeypatch.setattr(text_index, "TO_ORDER", 500, raising=False)
    docs = docs_of(spark, [(i, "s", f"{SAID[i % 5]} word{i}") for i in range(600)])
    index, before = TextIndex(store), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        index.build(docs)
        sizes = [r["count"] for r in index.index().postings.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) >= sum(sizes) // 500 and max(sizes) <= 1000
        same(docs, index.index())
        index.merge()
        assert len(index.index().postings.inputFiles()) >= sum(sizes) // 500
        same(docs, index.index())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# Ingest.


def test_batches_are_taken_once_and_late_comments_found(spark, store):
    said = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    comments = lambda: spark.createDataFrame(said, "doc_id long, comment_id long, comment_text string")
    ingest = Ingest(store, comments=comments, recent=1)
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, source_id string")
    assert ingest.take(batch([(1, "s"), (2, "s"), (2, "s"), (5, None)]), 0)
    said += [(1, 3, "late"), (2, 2, "late"), (3, 1, "new")]
    assert not ingest.take(batch([(3, "s")]), 0)  # handed over again
    assert ingest.take(batch([(1, "s"), (3, "s"), (1, "t")]), 1)
    marks = {r.source_id: (r.mark, r.documents, r.comments) for r in store.read("marks").collect()}
    assert marks["s"] == (3, 3, 4) and marks["t"][:2] == (1, 1)
    assert sorted((r.doc_id, r.comment_id) for r in store.read("comments").collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]


def test_a_stream_that_is_killed_before_it_notes_its_batch(spark, store):
    folder = shared_path(spark, "in")
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, source_id string").coalesce(1).write.mode("append").parquet(folder)
    write([(1, "s"), (2, "s")])
    stream = spark.readStream.schema("doc_id long, source_id string").parquet(folder)

    class Killed(Ingest):
        def take(self, batch, number):
            super().take(batch, number)
            raise RuntimeError("killed")

    point = shared_path(spark, "checkpoint")
    with pytest.raises(Exception, match="killed"):
        Killed(store).run(stream, point)
    assert store.versions() == [1]
    Ingest(store).run(stream, point)
    assert store.versions() == [1]  # the batch came again and was known
    write([(2, "s"), (3, "s")])
    Ingest(store).run(stream, point)
    assert [tuple(r) for r in store.read("marks").collect()] == [("s", 3, 3, 0)] and ids(store.read("documents")) == [1, 2, 3]


# The queue.


def sequential(events, fails, end):
    """What becomes of each group, by one scan."""
    out = []
    for group in {g for g, _, _ in events}:
        waits = None

        def due(until):
            nonlocal waits
            while waits and waits[0] <= until:
                at, n = waits
                ok = n > fails[group]
                out.append((group, at, "checked" if ok else "error" if n == 3 else "pending", n))
                waits = None if ok or n == 3 else (at + 60 * 2 ** (n - 1), n + 1)

        for _, at, n in sorted(e for e in events if e[0] == group):
            due(at)
            waits = (at, 1) if n else None
            if n:
                due(at)
            else:
                out.append((group, at, "no-comments", 0))
        due(end)
    return sorted(out)


@pytest.mark.parametrize("files", [1, 5])
def test_queue_is_as_one_scan_whatever_the_batches(spark, files):
    rng = random.Random(files)
    events = [(g, 1_700_000_000 + rng.randrange(900), rng.choice([0, 1, 4, 4])) for g in range(12) for _ in range(rng.randint(1, 3))]
    fails = {g: g % 4 for g in range(12)}
    end = max(at for _, at, _ in events)
    rows = spark.createDataFrame([(g, at, n, str(fails[g])) for g, at, n in sorted(events, key=lambda e: e[1])], "group_id long, s long, n_comments long, payload string")
    rows = rows.select("group_id", F.timestamp_seconds("s").alias("at"), "n_comments", "payload")
    folder = shared_path(spark, "queue")
    cuts = [1_700_000_000 + 900 * k / files for k in range(files + 1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows.filter((F.unix_seconds("at") >= a) & (F.unix_seconds("at") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def work(group, payload, attempt):
        if attempt <= int(payload):
            raise RuntimeError

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with W.timers(spark):
        got = jobs.run_once(W.worked(stream, work), "queue", folder)
    got = sorted((r.group_id, r.s, r.state, r.attempts) for r in got.select("group_id", F.unix_seconds("at").alias("s"), "state", "attempts").collect())
    assert got == sequential(events, fails, end)
    assert {s for _, _, s, _ in got} >= {"checked", "pending", "no-comments"}


# Pruning, replicas, sources.


def test_prune_takes_what_hangs_on_documents_and_can_be_undone(spark, store):
    docs = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2025-06-01")], "doc_id long, d string").select("doc_id", F.col("d").cast("timestamp_ntz").alias("created_at"))
    pairs = spark.createDataFrame([(2, 3), (1, 2)], "src long, dst long")
    store.publish(replace={"documents": docs, "links": pairs, "comments": table(spark, [1, 1, 3]), "vectors": table(spark, [1, 2]), "other": table(spark, [1])})
    assert P.prune(store, "2025-01-01") == {"documents": 1, "links": 1, "comments": 2, "vectors": 1}
    assert (ids(store.read("documents")), ids(store.read("comments")), ids(store.read("vectors")), ids(store.read("links"), "src"), ids(store.read("other"))) == ([2, 3], [3], [2], [2], [1])
    assert P.prune(store, "2025-01-01") == {}
    store.rollback(1)
    assert ids(store.read("documents")) == [1, 2, 3] and ids(store.read("vectors")) == [1, 2]


def test_replica_is_whole_or_as_it_was(spark, store):
    parents, children = table(spark, [1, 2], "id long"), spark.createDataFrame([(1, ' {"b":1, "a" : []}'), (2, "{}"), (2, None)], "parent long, j string")
    P.replicate({"p": parents, "c": children}, store, {"c": ["j"]}, {"c": ("parent", "p", "id")})
    assert sorted((r.parent, r.j or "") for r in store.read("c").collect()) == [(1, '{"a":[],"b":1}'), (2, ""), (2, "")]
    with pytest.raises(P.Refused):
        P.replicate({"p": parents.limit(1), "c": children}, store, {"c": ["j"]}, {"c": ("parent", "p", "id")})
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        P.replicate({"p": parents.limit(0), "c": spark.createDataFrame([(1, "{no")], "parent long, j string")}, store, {"c": ["j"]})
    assert store.versions() == [1] and store.read("p").count() == 2


def test_a_source_is_added_whole_or_not(spark, store):
    docs = lambda *x: lambda: spark.createDataFrame([(i, f"text {i}") for i in x], "doc_id long, text string")
    assert P.add_source(store, "new_1", "New", "channel", docs(1, 5)) == {"version": 1, "documents": 2, "mark": 5}
    for source_id, channel, made in (("Bad", "x", docs(9)), ("new_1", "x", docs(9)), ("other", "channel", docs(9)), ("other", "x", docs()), ("other", "x", docs(5))):
        with pytest.raises(P.Refused):
            P.add_source(store, source_id, "Other", channel, made)

    def broken():
        return docs(9)().withColumn("text", F.raise_error(F.lit("cut off")))

    with pytest.raises(Exception, match="cut off"):
        P.add_source(store, "other", "Other", "x", broken)
    assert store.versions() == [1] and ids(store.read("sources"), "source_id") == ["new_1"]
    P.add_source(store, "other", "Other", "x", docs(9))
    assert {r.source_id: r.mark for r in store.read("marks").collect()} == {"new_1": 5, "other": 9}
    assert {(r.doc_id, r.source_id, r.channel) for r in store.read("documents").collect()} == {(1, "new_1", "channel"), (5, "new_1", "channel"), (9, "other", "x")}


# Age limits.


def test_files_strictly_older_go(spark):
    folder = shared_path(spark, "artifacts")
    files, now = Files(spark, folder), 1_700_000_000
    for name, age in (("old.json", 7 * 86_400 + 1), ("edge.json", 7 * 86_400), ("new.json", 5), ("old.txt", 10**7)):
        files.create(f"{folder}/{name}", "12345")
        files.fs.setTimes(files.at(f"{folder}/{name}"), (now - age) * 1000, -1)
    files.create(f"{folder}/inner/old.json", "1")
    files.fs.setTimes(files.at(f"{folder}/inner/old.json"), 0, -1)
    assert retention.clean_files(spark, "x", folder, 0, now).skipped and retention.clean_files(spark, "x", f"{folder}/none", 7, now).deleted == 0
    got = retention.clean(spark, [("x", folder, 7.0)], now)
    assert (got["deleted"], got["deleted_bytes"], got["targets"][0].errors) == (1, 5, ())
    assert sorted(n for n in files.names(folder) if not n.startswith(".")) == ["edge.json", "inner", "new.json", "old.txt"]


def test_folders_that_are_busy_stay(spark):
    root = shared_path(spark, "artifacts")
    files, now = Files(spark, root), 1_700_000_000
    for name, age in (("old", 10), ("old.tmp", 10), ("locked", 10), ("new", 1), ("edge", 7)):
        files.create(f"{root}/2023-11-01/{name}/a.json", "123")
        if name == "locked":
            files.create(f"{root}/2023-11-01/{name}/.lock")
        files.fs.setTimes(files.at(f"{root}/2023-11-01/{name}"), int(now - age * 86_400) * 1000, -1)
    got = retention.clean_folders(spark, "x", root, 7, now)
    assert (got.deleted, got.kept) == (1, 4) and "old" not in files.names(f"{root}/2023-11-01")
    assert retention.clean_folders(spark, "x", root, 0.001, now, active=2 * 86_400).kept == 3  # new and busy ones


def test_tables_added_later_are_counted(spark):
    folder = shared_path(spark, "tables")
    table(spark, [1, 2]).write.parquet(f"{folder}/a.parquet")
    assert {r.name: r.n for r in counted(spark, tables_in(spark, folder)).collect()} == {"a": 2}
    table(spark, []).write.parquet(f"{folder}/b.parquet")
    assert {r.name: r.n for r in counted(spark, tables_in(spark, folder)).collect()} == {"a": 2, "b": 0}
    assert counted(spark, catalogued(spark)).columns == ["name", "n"]


def test_a_group_that_nothing_changes_for_costs_one_message():
    said = []

    class Handle:
        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            return lambda *args: said.append(name)

    queue = W.Queue()
    queue.init(Handle())
    rows = [{"seconds": 5.0, "n_comments": 0, "payload": None}, {"seconds": 1.0, "n_comments": 1, "payload": "x"}]
    assert [tuple(r) for r in queue.handleInputRows((7,), iter(rows), None)] == [(7, 1.0, "checked", 1), (7, 5.0, "no-comments", 0)]
    assert said == ["get"]
