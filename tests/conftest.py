import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from inkgauge.session import build_session, ship_package
    s = build_session("local[4]", 4, app_name="inkgauge-tests")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return SF001
