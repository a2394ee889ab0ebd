import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tidewatch.workspace import remove_folders


def local_session():
    from __spark_entry__ import _ship

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidewatch-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    _ship(spark.sparkContext)
    return spark


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    remove_folders(session)


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
