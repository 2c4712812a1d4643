import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# MARTWRIGHT_TEST_SF=/root/testdata/sf0.01 runs the table-based tests on a larger scale factor
SF_SMALL = os.environ.get("MARTWRIGHT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from martwright.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="martwright-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)  # scratch folder only because none is configured in tests
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL
