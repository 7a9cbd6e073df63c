"""Corpus queries that SQL can express give DuckDB's rows."""

from pathlib import Path

import duckdb
import pytest

from rareflow.llm.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{DATA}/documents.parquet'")
    sql = con.sql(ORACLE[name])
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(sql.columns)
    got = sorted(tuple(r) for r in df.select(*sql.columns).collect())
    assert got == sorted(sql.fetchall())
