import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from lexdrift.session import local_session

    s = local_session(4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
