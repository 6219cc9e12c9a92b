"""All registered queries of the text operators against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lexforge.plans import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_queries_without_sql(spark):
    left = set(QUERIES) - set(SQL)
    assert not left
    assert all(QUERIES[q](spark, DATA).count() for q in left)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(QUERIES) <= set(__spark_entry__.queries())
