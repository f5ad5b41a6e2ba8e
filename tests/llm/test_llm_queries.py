"""Registered queries beside their SQL on the smallest tables, where these are there."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from runweave.llm import queries as Q
from runweave.session import ship
from tools.compare import canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark):
    ship(spark)
    df = Q.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    mine = sorted(tuple(canonical(v) for v in r) for r in df.select(*cols).collect())
    if name not in Q.ORACLE:
        return
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    rel = con.sql(Q.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols and mine == sorted(tuple(canonical(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_found_columns(spark):
    want = {"p3_found": "repo_id test_path", "p4_found": "repo_id test_a test_b", "p6_ids": "doc_id ids", "p7_found": "doc_id item_id", "p8_found": "doc_id lang"}
    for name, cols in want.items():
        assert Q.QUERIES[name](spark, FOLDER).columns == cols.split()
