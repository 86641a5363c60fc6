"""Every query with SQL, on the smallest tables; the others must run."""

import os

import oracle
import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.views(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    frame = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert oracle.differences(frame, con, sql) == ""
    else:
        assert frame.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
