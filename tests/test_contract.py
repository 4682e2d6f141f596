"""Every registered query with an oracle gives the oracle's rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(name for name in contract.oracle_sql() if not name.startswith("op")))
def test_query_matches_oracle(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, duck.execute(contract.oracle_sql()[name]).df()) is None


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
