import pytest

from conftest import SF, same
from tallyfold.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Queries whose limits or constants are made for larger tables.
ELSEWHERE = {"projection_lag"}


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in ELSEWHERE])
def test_query_equals_its_sql(spark, duck, name):
    same(spark, duck, name, QUERIES, ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries())
    assert SF.startswith("/root/testdata")
