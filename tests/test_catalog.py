"""Every query with SQL gives the rows that the SQL gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import catalog

DATA = "/root/testdata/sf0.001"


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def same(spark, duck, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    mine = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(map(value, r)) for r in found.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["p2_normalize_nfkc", "l4_entity_split", "l5_shuffle", "g_serve_features", "g_train_features", "u_indel_ratio"])
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()}
