"""The pipeline's contract, and its queries against SQL on the smallest tables."""

from numbers import Number
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import queries as llm

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, DATA))
        assert out.columns == columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
        if name != "mixing":
            assert out.count() <= n
        n, docs = out.count(), out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.columns == ["doc_id", "n_tokens", "ids"] and last.count() == n


def test_stages_give_what_their_operators_say(spark):
    """The pipeline's rows against the operators' own decisions, one after another."""
    from collections import Counter

    from pyspark.sql import functions as F

    from tessera.llm import line_dedup, minhash, mixing, sentencepiece_scan, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    clean = docs.join(toxicity.score(docs, model).filter("score < 0.3").select("doc_id"), "doc_id", "left_semi").toPandas()
    cut = line_dedup.delete_repeats(spark.createDataFrame(clean, docs.schema)).select(*docs.columns).toPandas()
    assert len(cut) == len(clean)
    near = minhash.near_duplicates(spark.createDataFrame(cut, docs.schema)).toPandas()
    left = cut[cut["doc_id"].isin(near[near["kept"]]["doc_id"])]
    mixed = mixing.mix(spark.createDataFrame(left, docs.schema)).toPandas()
    times = {r.doc_id: r.repeats + int(2 * r.part >= max(r.size, 1)) for r in mixed.itertuples()}
    ids = {r.doc_id: list(r.ids) for r in sentencepiece_scan.encode(spark.createDataFrame(left, docs.schema)).collect()}
    want = Counter({i: n for i, n in times.items() if n})
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(r.doc_id for r in got) == want and all(list(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in got)


def test_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert llm.op9_toxicity(spark, str(tmp_path)).count() == 0


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = llm.queries()[name](spark, DATA).toPandas(), con.execute(llm.oracle_sql()[name]).df()
    order = list(sorted(want.columns))
    text = lambda df: sorted(tuple("" if pd.isna(v) else str(float(v)) if isinstance(v, Number) else str(v) for v in r) for r in df[order].itertuples(index=False))
    assert text(got) == text(want)
