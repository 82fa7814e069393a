import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mdq.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", "tests")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()
