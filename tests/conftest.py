import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    """Makes ``files(repo_id, path, content)`` from ``{path: text}`` or ``{repo: {path: text}}``."""

    def make(files):
        nested = {k: v for k, v in files.items() if isinstance(v, dict)} or {"repo": files}
        rows = [(repo, path, text) for repo, texts in nested.items() for path, text in texts.items()]
        return spark.createDataFrame(rows, "repo_id string, path string, content string")

    return make
