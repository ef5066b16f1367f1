import pytest

from quorumlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, app="tests", driver_memory="3g")
