"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from cytoplan.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


def canon(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "null" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{D}/{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, D)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    q = db.execute(SQL[name])
    want = canon([x[0] for x in q.description], q.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1]) and got[1] == want[1]
