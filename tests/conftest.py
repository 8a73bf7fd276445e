import pytest

from tests.helpers import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()
