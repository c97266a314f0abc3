import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    # Many small plans, each run once: the quick compiler alone is faster than warming up the other.
    session = local_session(
        "tallyflow-tests", 4, partitions=4, **{"spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1"}
    )
    yield session
    session.stop()


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
