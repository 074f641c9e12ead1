"""Queries of this package against their SQL on the smallest tables, where these are at hand."""

import os

import pytest

from quire.llm import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    df = catalog.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr)
    res = c.execute(catalog.oracle_sql()[name])
    order = [x[0] for x in res.description]
    assert sorted(order) == cols
    assert got == sorted((tuple(r[order.index(x)] for x in cols) for r in res.fetchall()), key=repr)
