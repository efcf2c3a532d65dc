import pytest

from ordinanza.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "4g", 4)
    yield s
    s.stop()
