import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glyphmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8, spark__driver__memory="8g", spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "hot"])
def hot_keys(request, monkeypatch):
    """Run a test without hot keys and again with every key of two or more rows treated as hot."""
    monkeypatch.setattr("glyphmill.operators.skew.MIN_HOT", 1 if request.param == "hot" else 1 << 40)
    return request.param
