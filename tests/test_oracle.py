"""Registered queries against their DuckDB oracle on the smallest scale."""

import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from oracle_compare import compare, duck

CHECKED = ["E11", "D5", "D9", "D10", "D11", "D12", "D12_cycles", "D13", "R6", "R15", "M4", "M6", "M7",
           "O5", "O5_no_dependencies", "O6", "O8", "O9", "P12", "S2", "S4", "M2", "M3", "M8", "K1", "K2", "O2"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["status"] == "ok", r


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = {"M5"}
    q, s = E.REGISTRY, E.oracle_sql()
    assert set(q) - set(s) == rows_only


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "is_misplaced" in df.columns
