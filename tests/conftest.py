import pytest

from sparkloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.driver.memory": "3g", "spark.sql.autoBroadcastJoinThreshold": "1m"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
