import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from quire.session import checkpoint_dir, get_spark

    s = get_spark("local[8]", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


@pytest.fixture(autouse=True)
def nothing_stays_cached(request):
    """A table that one test persists is not read by the plans of the next."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()
