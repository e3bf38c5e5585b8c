"""Every query of the core against its SQL, and that all of them run."""

import pytest

from siftnet.plans import catalog
from tests.compare import same

Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, data, duck, name):
    df = Q[name](spark, data)
    if name in SQL:
        assert same(df, duck.sql(SQL[name]))
    else:
        assert df.count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(Q)


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
