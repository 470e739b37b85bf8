"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.load().QUERIES, plans.load().SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name in SQL:
        out = duck.sql(SQL[name])
        at = [out.columns.index(c) for c in cols]
        assert len(out.columns) == len(cols)
        assert sorted(rows, key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)


def test_most_queries_have_sql():
    assert len(QUERIES) > 95 and len(set(QUERIES) - set(SQL)) <= 8
