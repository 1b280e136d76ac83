"""Every registered pattern query runs over whole tables and, where it has SQL, gives its rows."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from spanforge.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() else v
    return str(v)[:10] if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name in SQL:
        found = duck.sql(SQL[name])
        at = [found.columns.index(c) for c in sorted(df.columns)]
        assert sorted(found.columns) == sorted(df.columns)
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    else:
        assert rows


@pytest.mark.parametrize("name", ["optional_group_null", "capture_spans", "empty_matches", "version_pairs", "match_spans", "near_matches", "last_before", "sql_matches"])
def test_runs_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
