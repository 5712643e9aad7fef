import os
import tempfile

import pytest
from pyspark.sql import SparkSession

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="threadloom-tests-")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{scratch}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from threadloom.runtime import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test data here")
    return TESTDATA
