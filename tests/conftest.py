import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("FOLIANT_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from foliant.session import get_session

    session = get_session("tests", cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
