import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairwell.session import local_session  # noqa: E402


# Started on import, because test modules build columns at their top level.
SESSION = local_session()


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def values(spark):
    """Values of one column expression over rows of one text column ``x``."""

    def run(expression, rows, schema="x string"):
        frame = spark.createDataFrame([(row,) for row in rows], schema)
        return [row[0] for row in frame.select(expression).collect()]

    return run
