import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from provguard.session import local_session
    s = local_session("*", shuffle_partitions=8, app="provguard-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmp_base(spark):
    """Scratch folder under the session's checkpoint folder."""
    from provguard.session import scratch_path
    return scratch_path(spark, "tests")
