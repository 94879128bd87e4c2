"""Every registered query against its DuckDB oracle."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.01"
# The training-data queries have tests of their own.
QUERIES = {k: q for k, q in contract.queries().items() if k not in contract.LLM_QUERIES}
ORACLES = {k: q for k, q in contract.oracle_sql().items() if k not in contract.LLM_ORACLES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.sql(ORACLES[name])
    names = result.columns
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert got == want


def test_reports_are_ordered(spark):
    rows = contract.entry(spark).collect()
    assert [r.entity for r in rows] == sorted(r.entity for r in rows)
    assert len(rows) == 15
