import pytest

from inkspan.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    yield session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
