import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Small inputs keep all their range slices, so that borders are crossed.
    return local_session(**{"spark.sql.adaptive.coalescePartitions.enabled": "false"})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
