import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from datamill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """A small table from tuples and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
