import pytest

from stratalog.plans import catalogue, oracle
from tests.parity import assert_equal

SF = "/root/testdata/sf0.01"
SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, name):
    assert assert_equal(spark, SF, catalogue.QUERIES[name], SQL[name])


def test_catalogue_is_whole():
    assert set(SQL) == set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
