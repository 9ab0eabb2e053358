import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4, partitions=4, memory="4g")


@pytest.fixture(scope="session")
def rows(spark):
    """Rows of a DataFrame as sorted tuples of the named columns."""
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted(tuple(r) for r in picked.collect())
    return collect
