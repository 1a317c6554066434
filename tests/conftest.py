import pytest

from instqc.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "instqc-tests", master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.driver.host": "127.0.0.1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
