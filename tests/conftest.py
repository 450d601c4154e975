import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dwellrank.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a Column expression over one literal row."""

    def evaluate(expression, **values):
        from pyspark.sql import functions as F

        row = spark.range(1)
        for name, value in values.items():
            row = row.withColumn(name, F.lit(value))
        return row.select(expression.alias("v")).first()["v"]

    return evaluate
