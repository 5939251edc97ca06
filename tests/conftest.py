import pytest

from voxboard.session import local_session

# Columns are built while test modules are imported, which needs a session.
SPARK = local_session(8, "voxboard-tests")


@pytest.fixture(scope="session")
def spark():
    return SPARK
