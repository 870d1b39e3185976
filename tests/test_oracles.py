"""Every registered query against DuckDB, and the contract's shape."""

import pytest

import __spark_entry__ as contract
import check_oracles


@pytest.fixture(scope="module")
def con(sf):
    return check_oracles.connect(sf)


CORE = sorted(q.__name__ for q in contract.REGISTERED)


def test_contract():
    """Every query of the library itself has SQL, and no SQL is without a query."""
    assert set(CORE) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 1


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, con, sf, name):
    verdict = check_oracles.compare(spark, con, sf, name)
    assert not verdict.startswith("FAIL"), verdict
