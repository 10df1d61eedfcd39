import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spanloom import build_session
    session = build_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.python.sql.dataFrameDebugging.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
