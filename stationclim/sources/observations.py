"""Observation scans: the raw hive layout and the merged element table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import parse_yyyymmdd
from ..schema import ELEMENTS, MERGED_OBS_SCHEMA, RAW_OBS_SCHEMA


def scan_obs_partitioned(spark: SparkSession, root: str, elements: Sequence[str] = ELEMENTS,
                         stations: Iterable[str] | None = None) -> DataFrame:
    """Read ``root/STATION=*/ELEMENT=*/*.parquet`` with the declared 3-column schema.

    Extra file columns are not read; ``ELEMENT`` (and ``STATION``) come from the
    directory names, so the element filter prunes whole directories.  Works
    for any Hadoop file system root (local, HDFS, s3a).
    """
    schema = T.StructType(RAW_OBS_SCHEMA.fields + [T.StructField("STATION", T.StringType()), T.StructField("ELEMENT", T.StringType())])
    df = spark.read.schema(schema).option("basePath", root).parquet(root)
    df = df.where(F.col("ELEMENT").isin(*elements))
    if stations is not None:
        df = df.where(F.col("STATION").isin(*list(stations)))
    return df.select("ID", "DATE", "DATA_VALUE", "ELEMENT")


def parse_obs_dates(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Text ``yyyymmdd`` dates to ``date`` (strict: bad text fails the job)."""
    return raw.withColumn("DATE", parse_yyyymmdd("DATE", strict))


def scan_obs_merged(spark: SparkSession, root: str, elements: Sequence[str] = ELEMENTS,
                    stations: Iterable[str] | None = None) -> DataFrame:
    """Read the merged table ``root/ELEMENT=*/`` -> obs(ID, ELEMENT, DATE, DATA_VALUE).

    Element filters prune partitions; a station filter becomes a pushed
    parquet filter that row-group statistics can use (files are ID-sorted).
    """
    schema = T.StructType(MERGED_OBS_SCHEMA.fields + [T.StructField("ELEMENT", T.StringType())])
    df = spark.read.schema(schema).option("basePath", root).parquet(root)
    df = df.where(F.col("ELEMENT").isin(*elements))
    if stations is not None:
        ids = list(stations)
        df = df.where(F.col("ID") == ids[0]) if len(ids) == 1 else df.where(F.col("ID").isin(*ids))
    return df.select("ID", "ELEMENT", "DATE", "DATA_VALUE")
