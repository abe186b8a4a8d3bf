"""One local session for all tests."""

import pytest

from simforge.session import get_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_spark("local[4]", shuffle_partitions=4)
