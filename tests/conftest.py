import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from auralith.session import local_session

    session = local_session("tests", cores=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
