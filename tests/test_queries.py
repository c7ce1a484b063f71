"""Every bound query against its SQL twin on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = entry_point.SMALL
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple((type(row[i]).__name__, row[i]) for i in order) for row in rows)


LEARNED = [n for n in QUERIES if n == "pipeline" or n.startswith("op")]  # tested in tests/llm by force


def test_every_query_has_a_twin():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) <= set(LEARNED)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, df.collect()) == bag(columns, result.fetchall())


def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).count() > 0
