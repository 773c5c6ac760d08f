"""The problems' queries on the smallest tables: SQL where there is one, else rows and columns."""

import os

import duckdb
import pytest

from ridgeline.llm import queries

COLUMNS = {
    "p2_found": ["chunk_id", "qid"], "p3_found": ["chunk_id"], "p4_found": ["file_id"], "p5_found": ["chunk_a", "chunk_b"], "p6_found": ["chunk_id"],
    "p7_ids": ["doc_id", "ids"], "p8_found": ["plan_id", "source"], "p9_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert sorted(df.columns) == COLUMNS.get(name, sorted(df.columns)) and rows
    if name in COLUMNS and name != "p7_ids":
        assert len({tuple(r) for r in rows}) == len(rows)
    if name in queries.ORACLE:
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for f in os.listdir(data):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
        res = con.execute(queries.ORACLE[name])
        order = [[d[0] for d in res.description].index(c) for c in df.columns]
        assert sorted(tuple(r) for r in rows) == sorted(tuple(r[i] for i in order) for r in res.fetchall())
