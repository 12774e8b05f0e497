import os

import pytest

from matrixloom.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(int(os.environ.get("TEST_CPUS", "4")), "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
