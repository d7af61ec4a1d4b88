"""Every query that has SQL, against DuckDB on the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from petrelspark import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_graph():
    """The graphs of all orders' nets, of which many queries show a part, are explored once in these tests."""
    plain, made = {n: getattr(queries, n) for n in ("_graph", "_program_graph")}, {}
    for n, f in plain.items():
        setattr(queries, n, lambda spark, sf_dir, n=n, f=f: made[n, sf_dir] if (n, sf_dir) in made else made.setdefault((n, sf_dir), f(spark, sf_dir)))
    yield
    for n, f in plain.items():
        setattr(queries, n, f)


def cell(v):
    if v is None or v is pd.NA or v != v:
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v.item() if hasattr(v, "item") else v


def rows(df):
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_without_corpus_queries():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
