"""Every registered query of the engine against its SQL on the smallest tables."""

import math
from numbers import Real
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessera.operators import text_index
from tessera.plans import catalog, retrieval_plans

DATA = Path("/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return None if x is pd.NaT or x is pd.NA else x


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got, want = catalog.queries()[name](spark, str(DATA)).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v, r)) for r in rows(got)] == [tuple(map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v, r)) for r in rows(want)]


OF_THE_INDEX = ["fts_index", "fts_match_bm25", "fts_rescore", "gravity_rank", "hybrid_search", "overlap_sets", "random_augment", "rrf_merge"]


@pytest.fixture(scope="module")
def in_slices():
    """Indexes are made anew, of several slices of documents a task, as those of larger tables are."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(text_index, "TOGETHER", 8)
        patch.setattr(retrieval_plans, "INDEXES", {})
        yield


@pytest.mark.parametrize("name", OF_THE_INDEX)
def test_query_of_an_index_made_in_slices(spark, con, in_slices, name):
    test_query(spark, con, name)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of tables whose documents have ids that repeat (rows that are equal and rows that aren't), no id or no source, and letters whose case depends on their place."""
    folder = str(tmp_path_factory.mktemp("odd"))
    said = "thin from of the rethorn row {} of many, long enough to be eligible"
    rows = [(1000 + k % 3, said.format(k) + " of the thin" * k, "src1") for k in range(6)] + [(2000, said.format(0), "src2")] * 4
    rows += [(None, f"thin from of the nobody has this id {k}" + " reth" * k, "src3") for k in range(4)] + [(None, said.format("x"), "alone"), (None, f"{'other words only ' * 3}", "src3")]
    rows += [(3000, None, "src1"), (3001, "!" * 40, "src1"), (3002, said.format("nowhere"), None), (3003, "ΣΊΣΥΦΟΣ İSTANBUL thin of the σίσυφος istanbul", "src1"), (3004, said.format("s"), "lone"), (1000, said.format("t"), "src2")]
    c = duckdb.connect()
    c.execute(f"CREATE TABLE d AS SELECT * FROM '{DATA}/documents.parquet'")
    c.executemany("INSERT INTO d VALUES (?, ?, 'en', ?, ?)", [(i, t, s, len(t or "")) for i, t, s in rows])
    for name, made in (("documents", "SELECT * FROM d"), ("embeddings", f"SELECT * FROM '{DATA}/embeddings.parquet'")):
        c.execute(f"COPY ({made}) TO '{folder}/{name}.parquet'")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, c


@pytest.mark.parametrize("name", [*OF_THE_INDEX, "fts_tokenize", "has_embeddings_fallback", "circuit_fallback"])
def test_query_of_documents_with_odd_ids(spark, odd, name):
    folder, con = odd
    got, want = catalog.queries()[name](spark, folder).toPandas(), con.execute(SQL[name]).df()
    number = lambda v: float(v) if isinstance(v, Real) and not isinstance(v, bool) else v
    assert sorted((tuple(map(number, r)) for r in rows(got)), key=repr) == sorted((tuple(map(number, r)) for r in rows(want)), key=repr)
