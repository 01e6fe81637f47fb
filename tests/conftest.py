import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rankloom.session import Workspace, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=4, app="rankloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ws(spark, tmp_path_factory):
    return Workspace.use(spark, f"file:{tmp_path_factory.mktemp('shared')}")
