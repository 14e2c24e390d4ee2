"""Queries against their DuckDB SQL, and the pipeline stage by stage."""

import importlib

import duckdb
import pytest

from tessella.llm.oracles import ORACLES
from tessella.llm.queries import QUERIES

from .conftest import SF

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def plain(v):
    return None if v is None or v != v else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_pipeline_runs_its_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
    run = pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in docs.collect()) == sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in run)
