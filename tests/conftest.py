import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
