import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shipcast.session import local_session, release_tables
    s = local_session("*", shuffle_partitions=8, app="shipcast-tests")
    yield s
    release_tables(s)
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
