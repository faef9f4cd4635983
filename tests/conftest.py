import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabulon.session import get_session
    s = get_session("local[4]", 8, app_name="tabulon-tests")
    yield s


@pytest.fixture(scope="session")
def demo(spark):
    from tabulon.plans.fixtures import demo_sales
    return demo_sales(spark)
