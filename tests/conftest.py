from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tests.compare import make_spark

    s = make_spark()
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def con():
    from tests.compare import duck

    return duck(DATA)
