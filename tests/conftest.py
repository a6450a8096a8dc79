import pytest

from saldo.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="saldo-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
