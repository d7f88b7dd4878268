import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from floodplain.session import build

    session = build("local[8]", app="floodplain-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.default.parallelism": "4",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
