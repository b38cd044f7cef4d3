"""One Spark session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of sf0.001 as views."""
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows_of(frame):
    """Rows of a pandas frame as comparable tuples, columns by name."""
    import pandas as pd

    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, str):
            return v
        return round(float(v), 6) + 0.0

    return sorted((tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)
