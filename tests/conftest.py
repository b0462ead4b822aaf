import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from exposcope.session import get_spark
    # spark.checkpoint.dir comes from the session's configuration; get_spark
    # makes a fresh local folder only when none is named.
    s = get_spark("*", app="exposcope-tests", shuffle_partitions=8, driver_memory="8g")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
