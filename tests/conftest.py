import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from doorstep.session import build_session  # noqa: E402
from doorstep.sources.driver_model import DriverModel  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        # keep several ranges alive on small data
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def model(spark):
    return DriverModel(spark, SF)
