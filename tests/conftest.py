import pytest

from tablescape.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false", spark__sql__adaptive__coalescePartitions__enabled="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
