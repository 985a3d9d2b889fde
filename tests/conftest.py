import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from versewright import dims  # noqa: E402
from versewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def chapters(spark):
    return dims.versification(spark)
