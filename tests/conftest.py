import pytest

from corpusweave.runtime import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("4", 4, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.sparkContext.setLogLevel("ERROR")
    yield session
