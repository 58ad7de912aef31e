import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import local_session

    s = local_session("*", shuffle_partitions=8, app="tidewater-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a list of tuples (in row order)."""
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
