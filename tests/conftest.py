import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluates a column function on a list of rows and returns the results in order."""

    def evaluate(rows, schema, expression):
        if schema.count(" ") == 1:
            rows = [(row,) for row in rows]
        numbered = [(at, *row) for at, row in enumerate(rows)]
        df = spark.createDataFrame(numbered, f"__at int, {schema}")
        found = df.select("__at", expression.alias("result")).collect()
        return [row["result"] for row in sorted(found)]

    return evaluate


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
