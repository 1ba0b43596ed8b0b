"""The registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomtext import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_generated_workload_agrees(spark):
    rows = queries.QUERIES["workload_agreement"](spark, DATA).collect()
    assert len(rows) > 10 and all(r["left_rows"] == r["right_rows"] and r["differing"] == 0 for r in rows) and any(r["left_rows"] for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
