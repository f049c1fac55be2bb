import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from tessella.session import get_spark

    session = get_spark("tests", 4, 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
