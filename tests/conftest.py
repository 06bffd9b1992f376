from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from eventframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=8, app="eventframe-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
