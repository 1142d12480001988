import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from plume.session import local_session

    s = local_session(4, shuffle_partitions=4, app="plume-tests", driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from plume.session import scratch_path

    return scratch_path(spark, "test")
