import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lineweave.session import session

    s = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="2g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
