"""Every SQL-expressible registered query against its DuckDB oracle (sf0.001)."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

from __spark_entry__ import entry, oracle_sql, queries
from orchard.sources.tables import TABLES


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(records):
    return sorted((tuple(_norm(x) for x in r) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = _rows([tuple(r[c] for c in cols) for r in df.collect()])
    rel = duck.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for col, spark_type in df.dtypes:
        assert SPARK_TO_DUCK.get(spark_type) == duck_types[col], (col, spark_type, duck_types[col])
    idx = [rel.columns.index(c) for c in cols]
    want = _rows([tuple(r[i] for i in idx) for r in rel.fetchall()])
    assert got == want


def test_every_query_has_a_callable_and_most_an_oracle():
    qs, sqls = queries(), oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(sqls) >= 50


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "id", "score"]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
