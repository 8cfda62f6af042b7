import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("cohortlift-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Collect a DataFrame as a sorted list of tuples."""

    def collect(df, *columns):
        found = df.select(*columns).collect() if columns else df.collect()
        return sorted((tuple(r) for r in found), key=lambda t: [(v is not None, v) for v in t])

    return collect


@pytest.fixture(scope="session")
def plan():
    """Run a DataFrame and give the final physical plan (of adaptive execution) as text."""

    def text(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    return text
