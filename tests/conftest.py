import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from framespark.plans.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    from framespark.plans.ship import ship

    ship(s)
    yield s


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
