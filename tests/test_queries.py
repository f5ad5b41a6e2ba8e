"""Every registered core query beside its SQL, where the tables are there; those without SQL run on the smallest ones."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from runweave.plans import core_queries, layer1_queries, reference_queries, source_queries
from runweave.session import ship
from tools.compare import canonical

FOLDER, SMALLEST = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES = core_queries.QUERIES | reference_queries.QUERIES | layer1_queries.QUERIES | source_queries.QUERIES
SQL = core_queries.ORACLE | reference_queries.ORACLE | layer1_queries.ORACLE | source_queries.ORACLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for file in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    ship(spark)
    df = QUERIES[name](spark, FOLDER if name in SQL else SMALLEST)
    cols = sorted(df.columns)
    mine = sorted(tuple(canonical(v) for v in r) for r in df.select(*cols).collect())
    if name not in SQL:
        return
    rel = con.sql(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert not [t for t in map(str, rel.types) if t.startswith(("DECIMAL", "HUGEINT"))]
    assert mine == sorted(tuple(canonical(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)
