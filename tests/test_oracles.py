"""Every query equals its SQL on the driver's tables; those without SQL run."""

import pytest

from quarry.plans import ORACLES, QUERIES

from .oracle import DATA, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    compare(spark, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).collect()
