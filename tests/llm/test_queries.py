"""Operator queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from spanforge.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in sorted(df.columns)]
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
