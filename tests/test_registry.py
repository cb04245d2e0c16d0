"""The registered queries against their DuckDB SQL on the smallest test tables."""

import pytest

import __spark_entry__ as contract
import check
from podium.plans import oracles
from podium.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert check.compare(spark, con, FOLDER, name, ORACLES[name]) == ""
