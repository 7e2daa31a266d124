import pytest

from sextant.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "3g", 4)
