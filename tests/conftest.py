import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strata.session import get_session  # noqa: E402
from tests.events import CONF  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    log = {**CONF, "spark.eventLog.dir": tmp_path_factory.mktemp("events").as_uri()}
    s = get_session("local[4]", app="strata-tests", shuffle_partitions=8, conf=log)
    yield s
    s.stop()
