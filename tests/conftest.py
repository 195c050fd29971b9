import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from strata.session import checkpoint_dir, get_spark
    s = get_spark(cpus="*", shuffle_partitions=8, app="strata-tests",
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="strata-test-ckpt-")})
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
