import os

import pytest

from redolent.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("REDOLENT_DRIVER_MEMORY", "3g")
    s = build_session("tests", cpus=8, shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA
