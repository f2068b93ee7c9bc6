"""Defined cases of the first operators and of the pipeline: empty tables, very long texts, nulls, repeated rows, columns of clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat_format, embedding_dedup, mixing, suffix_dedup

CLASHES = ("bucket", "at", "size", "target", "taken", "c1", "c2", "spans", "rep", "kept", "segments", "formatted", "component", "n_links")


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def test_mixing_of_a_very_long_text_and_clashing_names(spark):
    rows = [(1, "w " * 500_000, "a"), (2, "x y", "a"), (2, "x y", "a"), (None, None, None), (4, "", "b")]
    got = mixing.mix(with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert len(got) == 5 and {(r.doc_id, r["size"]) for r in got} == {(1, 500_000), (2, 2), (None, 0), (4, 0)}
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)


@pytest.mark.parametrize("keep", ["first", "none"])
def test_repeated_strings_with_clashing_names(spark, keep):
    passage = " ".join(f"word{i}" for i in range(80))
    rows = [(1, "head " + passage), (2, passage + " tail"), (3, None), (4, "short"), (4, "short")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")), keep=keep).collect()}
    assert got[1].n_removed == (0 if keep == "first" else len(passage)) and got[2].n_removed == len(passage) and got[2].kept == b" tail"
    assert (got[3].n_bytes, got[3].kept_sha256, got[4].n_removed) == (0, hashlib.sha256(b"").hexdigest(), 0)


def test_chats_of_nothing_and_of_a_very_long_text(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert chat_format.render(chat_format.to_turns(spark.createDataFrame([], kind))).count() == 0
    long = "\\#<</turn>\n" * 200_000
    made = chat_format.render(chat_format.to_turns(with_clashes(spark.createDataFrame([(1, 0, "assistant", long), (1, 1, None, None)], kind)).select("conv_id", "turn", "role", "text")))
    (row,) = made.select(chat_format.parse_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()
    assert [(t["role"], t["text"] == long) for t in row.turns] == [("assistant", True), ("", False)] and row.loss == long


def test_vectors_of_nothing_and_with_clashing_names(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(with_clashes(spark.createDataFrame(rows, kind))).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6)}


def test_the_pipeline_on_an_odd_table(spark, tmp_path):
    text = lambda seed: " ".join(f"w{(i * i + seed) % 97}" for i in range(60))
    rows = [(i, text(i), "en", "s", 1) for i in range(12)] + [(0, text(0), "en", "s", 1), (20, None, None, None, None), (21, "", "en", None, 0), (None, text(3), "en", "t", 1), (22, "é" * 30_000, "fr", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumns({c: F.lit("clash") for c in ("bucket", "score", "h", "kept", "extra")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 3 == 0) for i in range(12)] + [(None, 1, True), (3, None, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int")).write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns, name
    got = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert len(got) == kept.count() and all(r.n_tokens == len(r.ids) for r in got)
