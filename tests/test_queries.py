"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference, duck

from swathgrid.plans import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(load()))
def test_query_agrees_with_sql(name, spark, con):
    assert difference(load()[name], spark, SF, con) is None


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
