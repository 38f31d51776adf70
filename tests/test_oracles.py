"""Registered queries vs their DuckDB oracles on sf0.001 (all of them)."""

import os

import pytest

from panelrisk.plans.check import compare, duck
from panelrisk.plans.oracle import oracle_sql

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, SF, con, verbose=False)
    assert res["status"] == "match", res


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert e.entry(spark).count() > 0
