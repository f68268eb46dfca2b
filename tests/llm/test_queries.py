"""Registered document queries: SQL oracles at sf0.001, and the pipeline."""

import duckdb
import pytest

from orchard.llm.oracle import ORACLE
from orchard.llm.queries import QUERIES
from orchard.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def _rows(records):
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(norm, r)) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert _rows([tuple(r[c] for c in cols) for r in df.collect()]) == _rows(
        [tuple(r[i] for i in at) for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_returns_every_document(spark, name):
    df = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert df.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    assert df.count() == docs.count()


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.exceptAll(docs).count() == 0 and out.count() > 0, name
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    at = 0
    for r in out:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert [r["doc_id"] for r in out] == sorted({r["doc_id"] for r in out})


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
