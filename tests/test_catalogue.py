"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from quillon.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def same_rows(spark, data, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df, expected = query(spark, data), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    order = [expected.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    same_rows(spark, data, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_topk_is_cut_before_the_shuffle(spark, data):
    plan = QUERIES["bm25_topk"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_read_only_what_they_need(spark, data):
    plan = QUERIES["missing_ids"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "text:string" not in plan
