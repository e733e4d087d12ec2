import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from skarn.session import local_session

    session = local_session(checkpoint_dir=tempfile.mkdtemp(prefix="spark-"))
    yield session
    session.stop()
