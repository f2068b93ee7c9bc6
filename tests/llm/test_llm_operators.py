"""The operators against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, embedding_dedup, line_dedup, merkle, minhash, mixing, sentencepiece_scan, suffix_array, suffix_dedup, toxicity, warc
from tessera.llm.components import components
from tessera.llm.storage import new_path

DOC = "doc_id long, text string, source string, copies int, bytes string"  # with names that operators use inside


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or {}).get(i, "s"), 1, "x") for i, t in texts], DOC)


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


# Mixing.


def test_water_fill_clamps_and_shares_again(spark):
    df = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 100, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(df, 210.0, 2.0).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx(126.6667, abs=1e-3) and got["c"] == pytest.approx(63.3333, abs=1e-3)
    full = {r.source: r.target for r in mixing.water_fill(df, 1e9, 2.0).collect()}
    assert full == {"a": 20, "b": 200, "c": 200}


def test_mix_takes_its_targets(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(["w"] * rng.randint(0, 40))) for i in range(300)] + [(300, None), (301, "")]
    df = docs_of(spark, texts, {i: f"s{i % 4}" for i in range(302)}).withColumn("source", F.when(F.col("source") != "s3", F.col("source")))
    rows = mixing.mix(df, digits=1).collect()
    again = mixing.mix(df, digits=1).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == 302
    by = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.size == len(dict(texts)[r.doc_id].split() if dict(texts)[r.doc_id] else [])
        by[r.source, r.target] += r.taken
    assert all(abs(n - target) <= 0.5 for (_, target), n in by.items())
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.take(df).columns == df.columns


@pytest.mark.parametrize("digits, share, epochs", [(1, 1.5, 2.0), (2, 0.4, 1.0), (1, 9.0, 2.0), (1, 1.0, 1.0)])
def test_take_is_what_mix_says(spark, digits, share, epochs):
    from collections import Counter

    rng = random.Random(5)
    texts = [(i if i % 50 else None, " ".join(["w"] * rng.randint(0, 9)) + f" id{i}" if i % 7 else "") for i in range(400)]
    docs = docs_of(spark, texts).withColumn("source", F.when(F.col("text") != "", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.char_length("text") % 3 + 1).cast("int"))))
    options = {"digits": digits, "share": share, "max_epochs": epochs}
    want = Counter()
    for r in mixing.mix(docs, **options).collect():
        want[r.doc_id, r.source, r.size] = max(want[r.doc_id, r.source, r.size], r.repeats + int(2 * r.part >= max(r.size, 1)))
    got = Counter((r.doc_id, r.text) for r in mixing.take(docs, **options).collect())
    size = lambda t: len(t.split())
    for r in docs.collect():
        assert got[r.doc_id, r.text] == want[r.doc_id, r.source, size(r.text)] * sum(1 for i, t in texts if (i, t) == (r.doc_id, r.text)), r
    assert mixing.take(docs.limit(0)).count() == 0 and mixing.take(docs).columns == docs.columns


def test_mixing_of_one_repeated_id(spark):
    docs = docs_of(spark, [(7, "a b c")] * 50 + [(None, "x y")] * 30 + [(None, None)] * 5)
    rows = mixing.mix(docs, share=1.0, max_epochs=1.0).collect()
    assert len(rows) == 85 and sum(r.taken for r in rows) == 210
    assert mixing.take(docs, share=1.0, max_epochs=1.0).count() == 85


# Suffix arrays.


def test_ranks_are_those_of_sorted_suffixes():
    rng = np.random.default_rng(1)
    for n, depth in ((200, 5), (300, 17), (500, 60), (0, 9)):
        data = rng.integers(1, 3, n).astype(np.uint8)
        raw = data.tobytes() + bytes(depth)
        keys = [raw[i : i + depth] for i in range(n)]
        want = [sorted(keys).index(k) for k in keys]
        assert suffix_array.ranks(data, depth).tolist() == want


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("many", [8192, 3])
def test_repeats_as_brute_force(spark, monkeypatch, keep, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2)
    monkeypatch.setattr(suffix_dedup.matched, "__defaults__", (20, 2, many))
    rng, n = random.Random(5), 20
    shared = ["".join(rng.choice("abcdé") for _ in range(rng.randint(15, 45))) for _ in range(6)]
    texts = [(i, "".join(rng.choice([rng.choice(shared), "".join(rng.choice("xyzñ") for _ in range(12))]) for _ in range(6))) for i in range(60)]
    texts += [(60, texts[3][1]), (61, None), (62, ""), (63, "ab" * 60), (64, "short")]
    seen, count = set(), defaultdict(int)
    data = {i: (t or "").encode() for i, t in texts}
    for b in data.values():
        for k in range(len(b) - n + 1):
            count[b[k : k + n]] += 1
    want = {}
    for i, b in sorted(data.items()):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            if count[s] > 1 if keep == "none" else s in seen:
                gone[k : k + n] = True
            seen.add(s)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest(), left)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs_of(spark, texts), keep, n, 6).collect()}
    assert got == want


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, [(1, "x")]).limit(0)).count() == 0


# Chat formatting.


def test_chat_round_trip_of_control_strings(spark):
    said = [r"\### Assistant: </turn> ok", "\n</turn>\n### user\n", "\\", "", None, "a\\\\#<b>"]
    rows = [(1, i, role, t, 0) for i, (role, t) in enumerate(zip(["user", "assistant", "assistant", "we\nird\\n", None, "assistant"], said, strict=True))] + [(None, 0, "user", "x", 0)]
    made = chat_format.render(chat_format.to_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")))
    got = made.filter("conv_id = 1").select(chat_format.parse_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("segments")).alias("l"), "formatted", "segments").first()
    assert [(t.role, t.text) for t in got.t] == [(r[2] or "", r[3] or "") for r in rows[:-1]]
    assert got.l == "".join((r[3] or "") for r in rows if r[2] == "assistant")
    assert "".join(s.text for s in got.segments) == got.formatted
    assert made.count() == 2


def test_layouts_by_fingerprint(spark):
    records = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","output":"a"}', '{"instruction":"q","input":"","output":"a"}', '{"prompt":"q","completion":"a"}', '{"question":"q","response":"a"}']
    turns = chat_format.records_to_turns(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).collect()
    twice = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q"), (2, 0, None, None)], "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    assert {r.conv_id: r.n for r in chat_format.render(chat_format.to_turns(twice)).select("conv_id", F.size(chat_format.parse_turns(F.col("formatted"))).alias("n")).collect()} == {1: 2, 2: 1}
    assert len(turns) == 12 and {(t.role, t.text) for t in turns} == {("user", "q"), ("assistant", "a")}
    typed = spark.createDataFrame([(1, "q", "a", 5)], "conv_id long, prompt string, completion string, extra int")
    assert [(t.role, t.text) for t in chat_format.to_turns(typed).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat_format.to_turns(spark.createDataFrame([(1,)], "conv_id long"))
    odd = spark.createDataFrame([(1, '{"x":1}')], "conv_id long, record string")
    assert chat_format.records_to_turns(odd, strict=False).count() == 0
    with pytest.raises(Exception, match="no known layout"):
        chat_format.records_to_turns(odd).collect()


# Line dedup.


def test_lines_as_brute_force(spark):
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6))) for _ in range(12)]
    texts = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(80, None), (81, "")]
    least, seen, want = 8, set(), {}
    for i, t in texts:
        own = (t or "").split("\n")
        gone = [False] * len(own)
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(x.strip() for x in own[a:b])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[a:b] = [True] * (b - a)
                    seen.add(run)
        want[i] = None if t is None else "\n".join(x for x, g in zip(own, gone, strict=True) if not g)
    out = line_dedup.clean(docs_of(spark, texts), least)
    assert out.columns == ["doc_id", "text", "source", "copies", "bytes"]
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert line_dedup.clean(docs_of(spark, texts).limit(0)).count() == 0


def test_lines_of_odd_tables(spark):
    """Columns with names used inside, null and repeated ids and rows, large ids beside null ones."""
    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(8)) for i in range(6))
    rows = [(5, run, "a", 1 << 60), (5, run, "b", None), (None, "top\n" + run, "c", 3), (7, run + "\nend", "d", 4), (5, "other\n" + run, "e", 5), (8, None, "f", 6), (9, "", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string, line long").withColumn("runs", F.array(F.struct(F.lit(1).alias("start")))).withColumn("d", F.lit("d"))
    got = line_dedup.clean(docs)
    assert got.schema == docs.schema
    by = {(r.doc_id, r.own): (r.text, r.line) for r in got.collect()}
    # Which of the two texts of id 5 is first is by the text's hash.
    firsts = {k: v for k, v in by.items() if k[0] == 5}
    kept = sorted(t for t, _ in firsts.values())
    assert kept in (sorted([run, run, "other"]), sorted(["", "", "other\n" + run]))
    assert by[None, "c"] == ("top", 3) and by[7, "d"] == ("end", 4) and by[8, "f"] == (None, 6) and by[9, None] == ("", 7) and by[5, "a"][1] == 1 << 60


def test_lines_of_very_long_texts(spark):
    import time

    began = time.time()
    blank = "\n" * 100_000 + "word " * 40
    assert line_dedup.outline(blank) is not None and line_dedup.outline("\n" * 300_000 + "x\n" * 29) is None
    assert time.time() - began < 10
    rng = random.Random(4)
    lines = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randint(0, 999)) for _ in range(12)) for _ in range(20_000)]
    texts = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[5000:5010], "more"])), (3, blank), (4, "before " * 31 + blank)]
    got = {r.doc_id: r.text for r in line_dedup.clean(docs_of(spark, texts)).collect()}
    assert got[1] == texts[0][1] and got[2] == "new\nmore" and got[3] == blank
    assert got[4] == "before " * 31


def test_windows_are_winnowed_and_matches_extended_both_ways():
    rng = random.Random(8)
    for _ in range(200):
        text = "\n".join(" ".join("x" * rng.randint(1, 2) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 20)))
        o = line_dedup.outline(text, 6)
        if o is None:
            continue
        digests, starts, ends, minima, _, _ = o
        assert minima.tolist() == [min(range(a, b), key=lambda j: (digests[j], -j)) for a, b in zip(starts, ends, strict=True)]
        assert (np.diff(minima) >= 0).all() and (np.diff(ends) >= 0).all()
    a, b = np.array([9, 1, 2, 3, 4, 5, 8]), np.array([7, 1, 2, 3, 4, 5, 6])
    assert line_dedup.extended(np.array([13]), np.array([14]), 10, a, 3, b, 7) == [(11, 16)]
    assert line_dedup.extended(np.array([10, 13]), np.array([11, 17]), 10, a, 3, b, 7) == []


# WARC.


def test_warc_round_trip_and_digests(spark, tmp_path):
    big = "é" * 60
    pages = [(3, "http://a/ b\r\n", big), (1, None, big), (2, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "x" * 200_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.round_trip(spark, df, payloads=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert got[i].payload is None if got[i].record_type == "revisit" else bytes(got[i].payload) == raw
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(raw)[0] == 1
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"payl0ad"))
    with pytest.raises(ValueError):
        warc.parse(raw[:-6])
    import zlib

    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
    member = gz.compress(raw) + gz.flush()
    assert list(warc.members(iter([member[:10], member[10:] + member]))) == [raw, raw]
    with pytest.raises(ValueError):
        list(warc.members(iter([member[:-4]])))


def test_records_of_odd_pages(spark):
    """Null and repeated ids, repeated rows, clashing names, a payload of over 1 MB."""
    big = "<p>long</p>" * 200_000
    pages = [(None, None, "x" * 200), (4, "u", "x" * 200), (4, "u", "x" * 200), (5, "v", big), (6, "w", big), (7, "z", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("refers_to", F.lit("r"))
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark, df).collect()), key=str)
    assert got == sorted([(0, "revisit", 4, 200), (4, "response", None, 200), (4, "response", None, 200), (5, "response", None, len(big)), (6, "revisit", 5, len(big)), (7, "response", None, 0)], key=str)


# Document fingerprints.


@pytest.mark.parametrize("ranges", [1, 3])
def test_merkle_edits(spark, ranges):
    rng = random.Random(7)
    texts = [(i, "\n".join(" ".join(rng.choice(["alpha", "béta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 8)))) for i in range(40)] + [(40, None), (41, "a"), (50, "a")]
    got = {r.doc_id: r for r in merkle.edits(docs_of(spark, texts), ranges).collect()}
    order = sorted((i for i, _ in texts), reverse=True)
    plain = {i: t or "" for i, t in texts}
    for k, i in enumerate(order):
        t, other = plain[i], plain[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[41].fingerprint == got[50].fingerprint
    assert merkle.edits(docs_of(spark, texts).limit(0), ranges).count() == 0
    assert merkle.edits(docs_of(spark, [(1, "one\ntwo")]), ranges).first().near_next == 1.0


def plain_likeness(a, b):
    """Dice's coefficient of the sets of parts of two texts, cut in a loop byte by byte."""
    from tessera.llm.hashing import BASE, TABLE

    def parts(data):
        out, start, mod = set(), 0, 1 << 64
        for i in range(len(data)):
            h = sum(int(TABLE[data[i - k]]) * pow(int(BASE), k, mod) for k in range(min(8, i + 1))) % mod
            h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) % mod
            if ((h ^ (h >> 29)) >> 40) % (1 << merkle.PIECE_BITS) == 0 or data[i] == 10 or i == len(data) - 1:
                out.add(data[start : i + 1])
                start = i + 1
        return out

    if a == b:
        return 1.0
    x, y = parts(a.encode()), parts(b.encode())
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def test_likeness_as_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "béta", "gamma", "delta", "eps"]) + str(rng.randint(0, 30))
    texts = [(i, "\n".join(" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5)))) for i in range(12)] + [(20, ""), (21, None), (22, "x"), (None, "null id"), (30, "same"), (31, "same")]
    docs = docs_of(spark, texts).withColumn("at", F.lit("clash")).withColumn("extra", F.lit(None).cast("array<int>"))
    plain = {i: t or "" for i, t in texts}
    order = sorted((i for i, _ in texts if i is not None), reverse=True) + [None]
    got = {r.doc_id: r for r in merkle.edits(docs, 3).collect()}
    assert len(got) == len(texts)
    for k, i in enumerate(order):
        own, other = plain[i], plain[order[(k + 1) % len(order)]]
        n = len(own)
        edited = own[: n - n // 3] + other[: n // 3]
        assert got[i].near_edited == pytest.approx(plain_likeness(own, edited)) and got[i].near_next == pytest.approx(plain_likeness(own, other))
        assert got[i].fingerprint.split(":")[0] == merkle.tree(own.encode())[0].hex() and (got[i].fingerprint == got[i].edited_fingerprint) == (own == edited)


def test_edits_of_a_very_long_text_and_ids_of_any_kind(spark):
    long = "".join(f"some words of a long text {i}\n" for i in range(60_000))
    rows = [(1 << 62, long), ((1 << 62) - 1, long + "x"), (-5, "a"), (-5, "b"), (None, "c")]
    got = sorted(merkle.edits(docs_of(spark, rows), 2).collect(), key=lambda r: (r.doc_id or 0, r.n_chars, r.edited_sha256))
    assert [r.doc_id for r in got] == [-5, -5, None, (1 << 62) - 1, 1 << 62] and got[-1].near_next > 0.8


def test_differing_branches_locate_an_edit():
    a = b"".join(b"line %d\n" % i for i in range(50))
    b = a.replace(b"line 17\n", b"changed\n")
    at = a.index(b"line 17\n")
    assert merkle.differing(merkle.tree(a), merkle.tree(b)) == ([(at, at + 8)], [(at, at + 8)])
    assert merkle.differing(merkle.tree(a), merkle.tree(a)) == ([], [])


# SentencePiece.


@pytest.fixture(scope="module")
def pieces():
    with open(sentencepiece_scan.MODEL, "rb") as f:
        return sentencepiece_scan.Pieces(f.read())


def test_ids_are_the_library_s_unigram_ids(pieces):
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(sentencepiece_scan.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    low = min(p.score for p in proto.pieces if p.type == 1 and p.score > sentencepiece_scan.NEVER) - 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = max(p.score, low)
    lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = lambda ids: sum(proto.pieces[i].score for i in ids)
    for text in ("the thinnest of words, in a line.", "Éenleier reeuxle des von eineinpf", "x²y 3.14 [a](b) don't"):
        assert score(pieces.encode(" " + text).tolist()) == pytest.approx(score(lib.encode(text)))


def scanned(pieces, text, size):
    """Ids of a text by the scan, in chunks of ``size``."""
    n = pieces.longest
    parts = [(text[k : k + size + n - 1], min(size, len(text) - k)) for k in range(0, len(text), size)]
    matrices = [pieces.transfer(t, s) for t, s in parts]
    start = np.array([0.0] + [-np.inf] * (n - 1))
    sums = sentencepiece_scan.forward(matrices, start)
    # Any order of products gives the same sums.
    left = matrices[0]
    for m in matrices[1:]:
        left = sentencepiece_scan.combine(left, m)
    right = matrices[-1]
    for m in matrices[-2::-1]:
        right = sentencepiece_scan.combine(m, right)
    assert (left == right).all()
    leaving = [0]
    for (t, s), f in list(zip(parts, sums, strict=True))[::-1]:
        first = pieces.first_cut(t, s)
        leaving.append(pieces.entries(t[:first] if first >= 0 else t, s, first, list(f))[leaving[-1]])
    assert leaving.pop() == 0
    return np.concatenate([pieces.trace(t, s, list(f), e) for (t, s), f, e in zip(parts, sums, leaving[::-1], strict=True)]).tolist()


def test_chunks_give_what_the_whole_gives(pieces):
    rng = random.Random(1)
    for trial in range(300):
        text = "".join(rng.choice(["the ", "thin", "er", " ", "é", "日本", "\n", "▁", "ing ", "%%"][: 4 if trial % 3 else 10]) for _ in range(rng.randint(60, 200)))
        if trial % 5 == 4:
            text = "".join(rng.choice("aeinrst") for _ in range(200))  # no place that a piece could not cross
        ids = scanned(pieces, text, rng.randint(2 * pieces.longest, 70))
        assert ids == pieces.encode(text).tolist()
        assert pieces.decode(np.concatenate([pieces.encode(" "), np.array(ids, np.int32)])) == text


def test_sums_are_the_best_of_all_segmentations(pieces):
    """Viterbi in its plainest form, with the tie rule: the longest last piece, and so on before it."""
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["the ", "a", "in", "er", " ", "é", "日", "\n", "▁", "s"]) for _ in range(rng.randint(1, 40)))
        spaced, n = text.replace(" ", "\0"), len(text)
        best, way = [0.0] + [-np.inf] * n, [[]] + [None] * n
        for j in range(1, n + 1):
            for i in range(j):  # from the longest last piece on
                hit = None if "▁" in text[i:j] else pieces.pieces.get(spaced[i:j].replace("\0", "▁"))
                if hit is None and j == i + 1:
                    hit = (None, pieces.unknown)
                if hit is not None and best[i] + hit[1] > best[j]:
                    best[j], way[j] = best[i] + hit[1], way[i] + ([hit[0]] if hit[0] is not None else pieces.spell(text[i]))
        assert pieces.encode(text).tolist() == way[n]


def test_ids_do_not_depend_on_chunks(spark):
    """Real texts, and others, as a whole and by the scan of the operator, with several groups of chunks a text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 6000).alias("text"))
    ids = lambda **options: {r.doc_id: r.ids for r in sentencepiece_scan.encode(docs, **options).collect()}
    want = ids()
    assert ids(giant=200, chunk=100) == want and ids(giant=1000, chunk=333) == want


def test_sentencepiece_round_trip(spark):
    texts = [(1, "plain words"), (2, None), (3, ""), (4, "  two  spaces\t\n"), (5, "▁literal ▁▁ \U0001f389"), (6, "long word " * 300), (7, "x" * 3000), (7, "x" * 3000), (None, "y z " * 400)]
    out = sentencepiece_scan.decode(sentencepiece_scan.encode(docs_of(spark, texts).withColumn("ids", F.lit(1)).withColumn("k", F.lit("k")), giant=500, chunk=100))
    assert sorted([(r.doc_id or -1, r.text) for r in out.collect()]) == sorted([(i or -1, t or "") for i, t in texts])
    assert sentencepiece_scan.encode(docs_of(spark, texts).limit(0)).count() == 0


def test_sentencepiece_of_a_very_long_text(spark):
    text = "the quick brown fox, " * 60_000
    r = sentencepiece_scan.decode(sentencepiece_scan.encode(docs_of(spark, [(1, text)]))).first()
    assert r.text == text


# Embeddings.


def test_embeddings_as_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 24))
    crowd = base[:1] + rng.normal(size=(200, 24)) * 0.05
    x = np.concatenate([base, crowd, base[5:6], base[5:6] * 3]).tolist()
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] * 24, 0), (904, [1.0], 0), (None, x[0], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    comps = union_find(range(len(x)), zip(*np.nonzero(np.triu(near, 1)), strict=True))
    assert len(got) == len(rows)
    assert {i: (got[i].n_links, got[i].component_id) for i in range(len(x))} == {i: (int(near[i].sum()) - 1, comps[i]) for i in range(len(x))}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (900, 901, 902, 903, 904))


def test_sparse_pairs_of_large_shards(spark):
    """Shards of over 256 vectors, where the graph is searched: rare pairs at the limit, beside a crowd whose links are many more."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3500, 48))
    far = rng.normal(size=(300, 48))
    x[:300] /= np.linalg.norm(x[:300], axis=1, keepdims=True)
    far -= (far * x[:300]).sum(1, keepdims=True) * x[:300]
    pairs = 0.905 * x[:300] + np.sqrt(1 - 0.905**2) * far / np.linalg.norm(far, axis=1, keepdims=True)
    x = np.concatenate([x, pairs, x[3499:] + rng.normal(size=(500, 48)) * 0.05])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(1) - 1
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = np.array([n for _, n in sorted((r.vec_id, r.n_links) for r in embedding_dedup.near_duplicates(rows).collect())])
    assert (got <= true).all()
    assert np.mean((got / np.maximum(true, 1))[(true > 0) & (true < 24)]) >= 0.97
    assert np.mean((got / np.maximum(true, 1))[true >= 24]) >= 0.97


@pytest.mark.parametrize("crowd,pairs,others", [(0, 1, 0), (0, 0, 0), (400, 30, 0), (0, 0, 40)])
def test_audit_widens_beams_that_lose_rare_links(monkeypatch, crowd, pairs, others):
    """A narrow beam that finds each vector itself and its crowd, but no rare link."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 32))
    x = np.concatenate([x, x[:1] + rng.normal(size=(crowd, 32)) * 0.02, x[1 : 1 + pairs] + rng.normal(size=(pairs, 32)) * 0.2])
    x = embedding_dedup.unit(x.tolist())
    asked = embedding_dedup.unit((x[100 : 100 + others] + rng.normal(size=(others, 32)) * 0.03).tolist()) if others else None

    def search(self, q, ef):
        s = q @ self.vectors.T
        if ef < 96:
            rare = (s >= 0.9).sum(1) < 24
            s[rare] = np.where(s[rare] > 0.99999, s[rare], -1)
        ids = np.argsort(-s, axis=1)[:, :ef]
        return ids, np.take_along_axis(s, ids, 1)

    monkeypatch.setattr(embedding_dedup.Graph, "search", search)
    ids = np.arange(len(x))
    shard = embedding_dedup.Shard(ids, np.ones(len(x), np.int64), x, 0.9, *([asked] if others else []))
    assert shard.ef >= 96


def test_graph_finds_most_neighbours():
    from tessera.llm.hnsw import Graph

    x = np.random.default_rng(0).normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    found, _ = graph.search(x[:200].astype(np.float32), 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, true, strict=True)]) > 0.9


# Toxicity.


def test_segments_are_all_maximal():
    def slow(s, a, b):
        """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return slow(s, a, i) + [(i, j)] + slow(s, j, b)

    rng = random.Random(9)
    for _ in range(60):
        s = [rng.randint(-40, 40) + rng.random() for _ in range(12)]
        assert [(a, b) for _, a, b in toxicity.segments(np.array(s))] == slow(s, 0, len(s))


def test_toxic_held_out(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "ne"]) for _ in range(3))
    rows, labels = [], []
    for i in range(1600):
        toxic = i % 6 == 0
        w = [word() for _ in range(rng.randint(5, 40))]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = "grumpx" + rng.choice("abcdefgh")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, marks = docs_of(spark, [*rows, (5000, None), (5001, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    import zlib

    held = [i for i in range(1600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == (i % 6 == 0) for i in held)
    assert right / len(held) > 0.97 and got[5000] == got[5001] < 0.3 and len(got) == 1602
    kept = {r.doc_id for r in toxicity.keep_clean(docs, marks).collect()}
    assert kept == {i for i, s in got.items() if s < 0.3}
    assert toxicity.score(docs, toxicity.train(docs, marks.limit(0))).agg(F.max("score")).first()[0] <= 0.5
    few, again = (toxicity.train(docs, marks, training=30) for _ in range(2))
    assert len(few.nodes.keys) and (few.nodes.keys == again.nodes.keys).all() and few.link == again.link


def test_rare_toxic_words_stay_among_many_clean_ones(spark):
    many = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("word"), F.lit(0).cast("long").alias("toxic_all"), F.lit(20).cast("long").alias("clean_all"))
    counts = many.unionByName(spark.createDataFrame([("zzgrump", 3, 0), ("to", 130_000, 0)], "word string, toxic_all long, clean_all long"))
    nodes = toxicity.log_odds(counts.withColumns({"toxic_first": F.col("toxic_all"), "clean_first": F.col("clean_all")}))["all"]
    assert nodes.scores[np.searchsorted(nodes.keys, toxicity.node_key("zzg*"))] > 0 and len(nodes.keys) > 60_000


def test_log_odds_and_scores_as_brute_force(spark):
    """Counts, the Dirichlet chain, the nodes kept and a text's score, each made again in plain Python."""
    import math

    rng = random.Random(5)
    bits = ["ba", "do", "ki", "é", "n"]
    vocabulary = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [(" ".join(rng.choice(vocabulary[: 60 if i % 3 else 15]) for _ in range(rng.randint(0, 12))), int(i % 3 == 0), i % 4 < 3) for i in range(240)]
    rows = spark.createDataFrame(texts, "text string, toxic int, counts boolean")
    counts = toxicity.node_counts(rows)
    got = toxicity.log_odds(counts)
    for p, use in (("first", [t for t in texts if t[2]]), ("all", texts)):
        of = defaultdict(lambda: [0, 0])
        for text, toxic, _ in use:
            for w in set(toxicity.words(text)):
                of[w][toxic] += 1
        root = sum(t for _, t in of.values()) / sum(map(sum, of.values()))
        logit = lambda q: math.log(min(max(q, 1e-6), 1 - 1e-6) / (1 - min(max(q, 1e-6), 1 - 1e-6)))
        sums = defaultdict(lambda: [0, 0])
        for w, (c, t) in of.items():
            for node in {w[:n] + "*" for n in toxicity.PREFIXES if len(w) >= n} | {w}:
                sums[node][0] += c
                sums[node][1] += t

        def share(node):
            s = node.rstrip("*")
            above = [s[:n] + "*" for n in toxicity.PREFIXES if (n < len(s) if node != s else n <= len(s))]
            prior = share(above[-1])[0] if above else root
            c, t = sums[node]
            return (t + toxicity.PRIOR * prior) / (c + t + toxicity.PRIOR), prior, c + t

        want = {}
        for node in sums:
            own, prior, n = share(node)
            if abs(logit(own) - logit(prior)) > 0.7 and (n >= 3 or own < prior):
                want[toxicity.node_key(node)] = logit(own) - logit(root)
        assert got[p].keys.tolist() == sorted(want) and np.allclose(got[p].scores, [want[k] for k in sorted(want)], atol=1e-5)
        # Every word by itself, as long as its node or a prefix's was kept.
        scored = toxicity.scorer(got[p])
        for w in [*vocabulary, "kikikikikiq", "q", "doq"]:
            chain = [w, *(w[:n] + "*" for n in reversed(toxicity.PREFIXES) if len(w) >= n)]
            best = next((want[k] for k in map(toxicity.node_key, chain) if k in want), 0.0) - toxicity.DRIFT
            assert scored([w])[0] == pytest.approx(best, abs=1e-5)
    model = toxicity.Model(got["all"], 1.3, -0.5, (-2.0, 0.7, 0.2, 0.4))
    of = toxicity.scorer(model.nodes)
    docs = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        s = of(toxicity.words(texts[r.doc_id][0])).tolist()
        found, todo = [], [(0, len(s))]
        while todo:
            a, b = todo.pop()
            best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 1e-9:
                found.append(best[0])
                todo += [(a, best[2]), (best[3], b)]
        e = sorted((1.3 * x + 0.5 - math.log(max(len(s), 1)) for x in found), reverse=True)
        top = [min(30, max(0, x)) for x in e[:2]] + [0, 0]
        z = -2 + 0.7 * top[0] + 0.2 * top[1] + 0.4 * math.log1p(sum(x > -math.log(0.05) for x in e))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_hashes_are_spark_s(spark):
    some = ["", "a", "né*", "x" * 100, "日本語"]
    assert [r.h for r in spark.createDataFrame([(w,) for w in some], "w string").select(F.xxhash64("w").alias("h")).collect()] == [toxicity.node_key(w) for w in some]


def test_toxicity_of_odd_tables(spark):
    """Null ids and texts, repeated rows and ids, clashing names, a long text, empty tables."""
    rows = [(None, "bad bad", "a", "x"), (1, "ok words", "b", "y"), (1, "ok words", "b", "y"), (1, "other text", None, None), (2, None, "c", "z"), (3, "ok bad " * 100_000, "d", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, h string").withColumn("toxic", F.lit(9)).withColumn("part", F.array(F.lit(None).cast("int")))
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.keep_clean(docs, marks, threshold=1.1).schema == docs.schema and toxicity.keep_clean(docs, marks, threshold=1.1).count() == 6
    assert toxicity.keep_clean(docs, marks, threshold=0.0).count() == 0
    assert toxicity.keep_clean(docs.limit(0), marks).count() == 0 and toxicity.keep_clean(docs, marks.limit(0), threshold=1.1).count() == 6


def test_calibration_counts_all_segments(spark):
    text = lambda k: " ".join((["bad"] + ["ok"] * 10) * k + ["ok"] * 11 * (140 - k))
    rows = [(i, text(140 if i < 50 else 70 if i < 100 else 0), int(i < 50)) for i in range(400)]
    model = toxicity.calibrate(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), toxicity.Nodes.of([toxicity.node_key("bad")], [10.0]))
    of = toxicity.scorer(model.nodes)
    z = [float(np.dot(toxicity.features(toxicity.segments(of(toxicity.words(text(k)))), 1540, model), model.link)) for k in (140, 70, 0)]
    assert z[0] > 1 > -1 > z[1] and z[2] < -1


def test_null_ids_repeated_rows_and_long_texts(spark):
    """op2, op4 and op10 on one odd table: each row of the input is a row of the result."""
    long = " ".join(f"w{i}" for i in range(150_000))
    texts = [(None, "n " * 300), (None, "n " * 300), (1, "a b c"), (1, "a b c"), (2, long), (3, long + " x"), (4, None), (5, "")]
    docs = docs_of(spark, texts).withColumn("own", F.lit(1)).withColumn("c1", F.lit("x")).withColumn("band", F.lit("y")).withColumn("component", F.lit(0))
    near = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    n = 150_000 - 4
    assert near == sorted([(0, 1, None, True)] * 2 + [(1, 1, 1, True)] * 2 + [(2, n, 2, True), (3, n + 1, 2, False), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.remove_repeats(docs, texts=False).collect()}
    assert cut[None, 600] == 600 and cut[2, len(long)] == len(long) and cut[3, len(long) + 2] == len(long) and cut[1, 5] == 0
    assert line_dedup.clean(docs).count() == len(texts) and minhash.keep_one(docs).columns == docs.columns


# MinHash and components.


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert got == {i: want[i] for i in got} and {x for a, b in pairs if a != b for x in (a, b)} == set(got)


def test_near_duplicates_as_brute_force(spark):
    rng, texts = random.Random(11), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    for g in range(12):
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append((len(texts), rng.choice(["{}", " {}\n", "{}"]).format(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))))
    texts += [(500, None), (501, ""), (502, " \t\n"), (503, texts[0][1]), (504, "É é"), (505, "é é")]
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(sets, pairs)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    kept = minhash.keep_one(docs_of(spark, texts))
    assert kept.columns == ["doc_id", "text", "source", "copies", "bytes"] and {r.doc_id for r in kept.collect()} == {i for i in sets if want[i] == i}
    assert minhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_paths_are_of_the_shared_folder(spark):
    assert new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
