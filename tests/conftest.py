from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from stationclim.session import ENGINE_CONF

    b = SparkSession.builder.master("local[*]").appName("stationclim-tests")
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    s = b.config("spark.sql.shuffle.partitions", "8").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # Tests only: a local checkpoint folder when the session names none.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stationclim-test-ckpt-"))
    yield s
    s.stop()


def obs_frame(spark, rows):
    """rows: (ID, ELEMENT, 'yyyy-mm-dd', value|None) -> obs DataFrame."""
    import datetime as dt

    data = [(i, e, dt.date.fromisoformat(d), v) for i, e, d, v in rows]
    return spark.createDataFrame(data, "ID string, ELEMENT string, DATE date, DATA_VALUE bigint")
