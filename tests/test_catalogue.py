"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from ridgeline.plans import catalogue, core_queries

QUERIES = catalogue.QUERIES | core_queries.QUERIES
ORACLE = catalogue.ORACLE | core_queries.ORACLE


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    res = duck.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_every_query_reads_whole_tables():
    """No plan source holds a modulo filter or sample on ids."""
    import inspect

    text = inspect.getsource(catalogue)
    assert ".sample(" not in text and "TABLESAMPLE" not in text


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_columns_they_need(spark, data):
    plan = plan_of(QUERIES["store_counts"](spark, data))
    assert "ReadSchema: struct<project:string,path:string>" in plan and "text" not in plan


def test_scope_is_pushed_to_the_scan(spark, data):
    assert "PushedFilters: [In(project" in plan_of(QUERIES["search_members"](spark, data))


def test_top_k_is_not_a_full_sort(spark, data):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["bm25_topk"](spark, data))
