import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("LEDGERTIDE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from ledgertide.session import local_session

    session = local_session(partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
