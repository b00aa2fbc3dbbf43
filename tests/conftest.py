import pytest

from lodestone.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
