"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference
from checks.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_its_sql(spark, con, name):
    diff, _, _, _ = difference(spark, con, SF, name)
    assert diff is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["avg_elapsed_time", "query_id"]
