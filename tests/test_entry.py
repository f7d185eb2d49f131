"""The driver's contract, and every query against its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillbase.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_mktsegment", "quantity"] and df.count() == 5


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    bag = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert bag(tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()) == bag(want.fetchall())
