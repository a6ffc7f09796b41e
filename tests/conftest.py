import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sourceloom.session import build_session
    session = build_session("tests", "local[4]", {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate one expression over literal strings: column(fn, [inputs]) -> list of results."""
    from pyspark.sql import functions as F

    def run(fn, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)
        return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]
    return run
