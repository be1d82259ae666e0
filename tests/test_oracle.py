"""Every registered query with SQL gives the same rows as DuckDB."""

import os

import pytest

import __spark_entry__ as contract
import check_oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
SMOKE = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def connection():
    return check_oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    verdict, _, rows = check_oracle.compare(spark, connection, name, SF_DIR)
    assert verdict == "equal"
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert contract.queries()[name](spark, SMOKE).count() > 0


def test_flagship(spark):
    assert contract.entry(spark).count() == 4
