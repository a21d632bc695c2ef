import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aerolith import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    built = session.build("local[*]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def hourly(spark):
    """Build a series from a list of values: one row per hour, None drops nothing."""
    def make(values, station="a", start="2024-01-01", skip=()):
        rows = [(station, i, None if v is None else float(v)) for i, v in enumerate(values) if i not in skip]
        return spark.createDataFrame(rows, "station string, h int, us_aqi double").selectExpr(
            "station", f"timestamp'{start}' + make_dt_interval(0, h) AS ts", "us_aqi")

    return make


def column(df, name, order="ts"):
    return [row[name] for row in df.orderBy(order).select(name).collect()]
