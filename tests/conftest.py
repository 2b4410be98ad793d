import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from strandlake.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "4"), partitions=4, memory="3g")
    yield s
    s.stop()
