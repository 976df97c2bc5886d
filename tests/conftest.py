import pytest

from millrace.session import build_session


@pytest.fixture(scope="session")
def spark():
    extra = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    }
    session = build_session("tests", master="local[8]", **extra)
    session.sparkContext.setLogLevel("ERROR")
    return session
