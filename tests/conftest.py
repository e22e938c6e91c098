import pytest

from lexiloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
