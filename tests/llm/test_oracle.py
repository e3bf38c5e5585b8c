"""Every query of the subpackage against its SQL, and that all of them run."""

import pytest

from siftnet.llm.queries import QUERIES, SQL
from tests.compare import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert same(df, duck.sql(SQL[name]))
    else:
        assert df.count() > 0
