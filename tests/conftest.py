import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from litsieve.session import build_session
    s = build_session("local[4]", app="litsieve-tests", shuffle_partitions=8)
    yield s
