import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from galeledger.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g", app="tests")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as plain tuples, sorted when ``order`` is given."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
