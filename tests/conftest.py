import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakekit.session import get_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "lakekit-tests", "local[4]", {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a result as plain tuples, sorted."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
