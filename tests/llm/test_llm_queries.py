"""The queries of the training-data operators that have SQL, against DuckDB on the smallest tables; all others run."""

import os

import duckdb
import pytest

from cytoplan.llm.queries import QUERIES, SQL
from tests.test_queries import D, canon

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        c = duckdb.connect()
        for f in os.listdir(D):
            c.execute(f"create view {f[:-8]} as select * from read_parquet('{D}/{f}')")
        q = c.execute(SQL[name])
        assert canon(df.columns, rows) == canon([x[0] for x in q.description], q.fetchall())
