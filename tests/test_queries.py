"""Every query with a SQL twin against DuckDB on the smallest tables; the others must run and have rows."""

import pytest

from corpusloom.plans import registry
from helpers import duck, same

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, con, name):
    ok, why = same(registry.QUERIES[name](spark, SF), con, registry.SQL[name])
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == registry.QUERIES[registry.FLAGSHIP](spark, SF).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
