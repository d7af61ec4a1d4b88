"""The registered queries on the smallest tables: against SQL where there is some, and the pipeline against its stages in one process."""

import os
import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from petrelspark.llm import oracles, queries, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def cell(v):
    """A column of whole numbers with nulls comes as floats from one side and as nullable numbers from the other."""
    if v is None or v is pd.NA or v != v:
        return "null"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def rows(result):
    names = sorted(result.columns)
    return sorted(tuple(cell(r[n]) for n in names) for r in result.to_dict("records"))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(oracles.ORACLES[name]).df())


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    now, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == spark.read.parquet(f"{SF}/documents.parquet").columns, name
        kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    assert len(docs) > len(kept[0]) > 0.7 * len(docs)
    squeezed = {re.sub(r"[\x20\x09-\x0D]+", "", t) for t in kept[0].values()}
    assert len(kept[1]) == len(squeezed) and len(kept[2]) <= len(kept[1])
    assert set(kept[3]) == set(kept[2]) and not any(secrets.base_spans(t) for t in kept[3].values())
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == set(kept[3]) and packed.groupby("sequence_id").length.sum().max() <= 4096
