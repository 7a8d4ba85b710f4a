import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def rows(df) -> list:
    """A Spark or pandas frame as sorted rows, by column name, floats to nine digits, nulls alike."""
    import pandas as pd

    pdf = df if isinstance(df, pd.DataFrame) else df.toPandas()

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x

    columns = sorted(pdf.columns)
    return [columns, sorted(([plain(x) for x in r] for r in pdf[columns].itertuples(index=False, name=None)), key=repr)]
