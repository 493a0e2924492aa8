import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build_session

    session = build_session("tests", cpus=8, partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
