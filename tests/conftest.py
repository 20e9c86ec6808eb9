import pytest

from termloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    steps = tmp_path_factory.mktemp("steps")
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.checkpoint.dir": str(steps), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
