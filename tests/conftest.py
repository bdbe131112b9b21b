import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from agreelens.session import local_session, remove_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("agreelens-tests", cpus=8, shuffle_partitions=4, memory="6g")
    yield session
    remove_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
