"""Wide per-station files ``root/STATION=<id>/*.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import WIDE_SCHEMA


def scan_wide_station_file(spark: SparkSession, root: str) -> DataFrame:
    """All stations at once; ``STATION`` comes from the directory name."""
    schema = T.StructType(WIDE_SCHEMA.fields + [T.StructField("STATION", T.StringType())])
    df = spark.read.schema(schema).option("basePath", root).parquet(root)
    return df.select("STATION", *WIDE_SCHEMA.fieldNames())
