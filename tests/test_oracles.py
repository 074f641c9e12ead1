"""Core queries against their SQL on the smallest tables, where these are at hand."""

import datetime
import os

import pytest

from quire import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(D):
        c.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(catalog.oracle_sql()[name])
    order = [x[0] for x in res.description]
    assert sorted(order) == cols
    want = sorted((tuple(plain(r[order.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_islands_equal_the_kernel(spark):
    from pyspark.sql import functions as F

    from quire.plans.inspect import book_blocks

    one = lambda k: F.count_if(F.col("kind") == k)
    kernel = book_blocks(spark, D).where("kind in ('paragraph', 'heading', 'list', 'quote')").groupBy("book_id").agg(one("paragraph"), one("heading"), one("list"), one("quote"))
    sql = catalog.queries()["block_islands"](spark, D).select("book_id", "paragraphs", "headings", "lists", "quotes")
    assert sorted(map(tuple, kernel.collect())) == sorted(map(tuple, sql.collect()))
