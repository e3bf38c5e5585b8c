import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("SIFTNET_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from siftnet.session import local_session

    s = local_session("tests", cores=4, shuffle_partitions=4, spark__driver__memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{data}/{f}'")
    return con
