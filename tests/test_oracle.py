"""Every SQL-checked query equals its DuckDB twin (row count, columns, values)."""

import pytest

import __spark_entry__ as E
from datasets import SF_SMALL
from tabflow.plans.oracle_check import compare, duck_connect

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, SF_SMALL, key, E.queries()[key], E.oracle_sql()[key])
    assert r["ok"], r["note"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and 0.0 <= rows[0]["coverage"] <= 1.0
