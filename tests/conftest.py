import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def sf_medium():
    return f"{TESTDATA}/sf0.01"


@pytest.fixture()
def folder():
    """A new scratch folder."""
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture()
def scan(spark):
    """Findings of ``{path: text}`` as ``(path, line, rule_ord)``."""
    from flawsieve import scan_table

    def run(files, **options):
        df = spark.createDataFrame(list(files.items()), "path string, content string")
        rows = scan_table(df, **options).select("path", "line", "rule_ord").collect()
        return sorted(tuple(row) for row in rows)

    return run
