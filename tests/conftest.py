import pytest

from corpusloom.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
