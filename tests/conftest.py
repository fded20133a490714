import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from talentspark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture
def one(spark):
    """Evaluate a column function on single values."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [row[0] for row in df.select(fn(F.col("v"))).collect()]

    return run
