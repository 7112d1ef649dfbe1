"""Every catalogue query against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sharelens.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return repr(v) if not isinstance(v, float) else "nan" if math.isnan(v) else f"{v:.10g}"


KIND = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR)
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: t for c, t in got.dtypes} == {c: KIND[kinds[c]] for c in columns}
    rows = sorted([plain(r[c]) for c in columns] for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
