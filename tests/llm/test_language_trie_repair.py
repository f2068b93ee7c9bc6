"""Language identification, the prefix trie and the repair of conversations: held-out accuracy, brute force and defined cases."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, prefix_trie, structure_repair

DATA = "/root/testdata/sf0.001"
#: With names that the operators use inside.
TURN = "conv_id long, turn long, role string, text string, pos int, key string, label int, audit string, depth int"
SPACE = r"[^\x20\x09-\x0d]"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "a", 3) for r in rows], TURN)


def some_turns(seed=5):
    """Shared beginnings, repeated rows, rows of equal turn, nulls, blank and cut-off texts, unknown roles, gaps, ids beyond a family."""
    rng, rows = random.Random(seed), []
    texts = ["Hello there.", "cut off", "", "  \t\n", "What? Yes!", "a. b! c? ", None, "Ünï codé 中文.", "\u000b\u000c"]
    for conv in [0, 1, 2, 3, 4, 5, 19, 20, 21, 22, 39, 41, 57, 60, 61, 100, -3, -20]:
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice(texts)))
    return rows + rows[:6] + [(None, 1, "user", "nobody's.")] * 2


# Language.


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_is_learnt_from_the_training_part_alone(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    other = docs.withColumn("lang", F.when(language_id.part(F.col("doc_id")) == 2, F.reverse("lang")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    rows = lambda df: sorted(map(tuple, language_id.identify(df).collect()))
    assert rows(docs) == rows(other)


def test_language_defined_cases(spark):
    odd = [(10_000, None, "en"), (10_001, "", "en"), (10_002, "12 345 -- ²", "fr"), (10_003, "x", None), (None, "und der die das ist nicht", "de"), (10_004, "le " * 60_000, None), (10_004, "le " * 60_000, None)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumns({c: F.lit(1) for c in ("h", "place", "held_out", "score")})
    got = {}
    for r in language_id.identify(docs).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, r.score))
    assert all([x[1:] for x in got[i]] == [("und", 0.0)] for i in (10_000, 10_001, 10_002))
    assert got[10_004][0] == got[10_004][1] and got[10_004][0][1] == "fr" and got[None][0][0] is False and got[10_003][0][1] != "und"
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = language_id.identify(docs.limit(5).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    one = language_id.identify(docs.filter("text IS NOT NULL AND doc_id < 40").withColumn("lang", F.lit("en"))).collect()
    assert {r.lang_pred for r in one} == {"en"}


def test_language_features_are_kernels_with_the_landmarks():
    texts = ["Der Hund ist nicht da.", "the dog, the dog", "x"]
    own = language_id.landmark_weights([(t, 0) for t in texts[:2]])

    def presence(t):
        t = language_id.normalized(t)
        return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    want = [[len(presence(a) & presence(b)) / (len(presence(a)) * len(presence(b))) ** 0.5 for b in texts[:2]] for a in texts]
    assert np.allclose(own.of(texts), want, atol=1e-6)


# The trie.


def brute_trie(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {k: [r[2:] for r in sorted(v)] for k, v in by.items()}
    nodes, kids, below = {}, {}, {}
    for k, own in turns.items():
        h = zlib.crc32(str(k).encode()) % 4
        s = tuple(turns.get(k - int(np.fmod(k, 20)), [])[:h] + own[h:])
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append((k, d == len(s)))
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[p]) - 1) * (len(re.findall(SPACE + "+", p[-1][1])) if p else 0)
        down = [below[x] for x in kids.get(p, [])]
        below[p] = (sum(x[0] for x in down) or 1, saved + sum(x[1] for x in down))
    return sorted(
        (min(k for k, _ in m), len(p), min(k for k, _ in nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below[p], hashlib.sha256(",".join(map(str, sorted(k for k, e in m if e))).encode()).hexdigest())
        for p, m in nodes.items()
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("wide", [2, 3, 4096])
def test_trie_is_as_by_brute_force(spark, wide):
    rows = some_turns() + [(c, t, "user", f"turn {t} {'x ' * t}") for c in range(200, 240) for t in range(7 if c % 2 else 4)]
    got = prefix_trie.trie(turns_of(spark, rows), wide=wide).select(NODE).collect()
    key = lambda r: (r[1], r[0], r[7], r[3], r[6])
    assert sorted(map(tuple, got), key=key) == sorted(brute_trie(rows), key=key)


def test_trie_of_one_long_and_of_no_conversation(spark):
    rows = [(c, t, "user", "same words") for c in (1, 2) for t in range(300)]
    got = prefix_trie.trie(turns_of(spark, rows), exchange=False).select(NODE).collect()
    assert len(got) == 301 and {r.n_convs for r in got} == {2} and {r.n_leaves for r in got} == {1}
    assert {r.depth: r.saved_tokens for r in got}[0] == 600
    assert prefix_trie.trie(turns_of(spark, [])).count() == 0


def test_many_ends_are_hashed_in_stretches(spark):
    ends = spark.range(10_000).select(F.lit(bytearray(b"k" * 16)).alias("key"), F.col("id").alias("conv_id"))
    (row,) = prefix_trie.end_digests(ends).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(10_000))).encode()).hexdigest()


def test_level_order_bits_give_parents_children_and_sums():
    rng = random.Random(2)
    up, level = [-1, -1], [0, 0]
    for i in range(2, 200):
        up.append(rng.randrange(i))
        level.append(level[up[i]] + 1)
    names = np.array([hashlib.md5(str(i).encode()).digest() for i in range(200)], "S16")
    parent = np.array([names[u] if u >= 0 else b"" for u in up], "S16")
    shuffled = np.array(rng.sample(range(200), 200))
    trie = prefix_trie.Louds(np.array(level)[shuffled], names[shuffled], parent[shuffled], names[::-1][shuffled])
    rows = shuffled[trie.order]
    assert [(rows[p] if p >= 0 else -1) for p in trie.parents()] == [up[r] for r in rows]
    for place, r in enumerate(rows):
        a, b = trie.children(place)
        assert sorted(rows[a:b]) == [i for i in range(200) if up[i] == r] and list(trie.labels[a:b]) == sorted(trie.labels[a:b])
    value = np.arange(200)
    want = value.copy()
    for i in range(199, 1, -1):
        want[up[i]] += want[i]
    (sums,) = trie.rolled(value[shuffled])
    assert (sums == want[shuffled]).all()


# Repair.


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def brute_repair(rows):
    """Cheapest edits by Dijkstra's search over (rows done, state)."""
    seen, fault = set(), []
    for _, role, text in rows:
        said = re.findall(SPACE, text)
        fault.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    then = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        name, to = then[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*made, (name, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, made))
            if fault[i] not in ("b", "d"):
                more = fault[i] == "t"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*made, (name, text))))
                if role[:1] == name[0]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*made, (role, text))))
                if role[:1] == "s" and not state:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1, (*made, (role, text))))


FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("block", [1, 3, 512])
def test_repair_is_as_by_brute_force(spark, block):
    rows = some_turns() + [r for seed in range(3) for r in [(1000 * seed + c, *rest) for c, *rest in some_turns(seed) if c is not None and c >= 0] if seed]
    got = {r.conv_id: tuple(r[c] for c in FOUND) for r in structure_repair.repair(turns_of(spark, rows), block=block).collect()}
    by = {}
    for conv, *rest in rows:
        if conv is not None:
            by.setdefault(conv, []).append((conv, *rest))
    assert got == {conv: brute_repair(after_damage(own)) for conv, own in by.items()}


def test_a_conversation_longer_than_a_batch(spark):
    rows = [(7, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(3000)]
    (got,) = structure_repair.repair(turns_of(spark, rows), damage=False).collect()
    assert (got.cost, got.audit, got.truncated, got.gaps) == (4, "I" + "K" * 3000 + "I", 0, 0)
    whole = [("user", ""), *(r[2:] for r in rows), ("assistant", "")]
    assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in whole).encode()).hexdigest()


def test_repair_of_nothing(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = structure_repair.repair(turns_of(spark, [(5, gone, "user", "x.")])).collect()
    assert tuple(row[c] for c in FOUND) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert structure_repair.repair(turns_of(spark, [])).count() == 0
