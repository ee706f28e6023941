import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from foliant.session import build_session

    s = build_session("tests", "local[8]", 8, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
