import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarrylight.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(int(os.environ.get("TEST_CPUS", "8")), 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(autouse=True)
def written_tables(request):
    """What a test has written goes when it ends."""
    yield
    if "spark" in request.fixturenames:
        release(request.getfixturevalue("spark"))
