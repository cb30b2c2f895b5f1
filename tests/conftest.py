import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scoutline.session import local_session
    # Tests run locally: give the session its own checkpoint folder.
    s = local_session(4, shuffle_partitions=8, app="scoutline-tests",
                      extra_conf={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt")),
                                 "spark.buffer.size": "4096"})       # a test counts the bytes read
    yield s


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
