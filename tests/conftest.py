"""One session for all tests."""

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelforge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, spark__checkpoint__dir=f"file://{tempfile.mkdtemp(prefix='labelforge-tests-')}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as tuples in a fixed order."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
