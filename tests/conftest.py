import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from folioframe.session import BUILD_SETTINGS, tune

    b = SparkSession.builder.master("local[*]").appName("tests")
    for k, v in {**BUILD_SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.enabled": "false",
                 "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")}.items():
        b = b.config(k, v)
    s = tune(b.getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def fresh_dir():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
