"""Read the engine's own CSV outputs back (the chart tables' input)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import DAILY_COLUMNS, HISTORY_COLUMNS, HISTORY_COUNT_COLUMNS, MONTHLY_COLUMNS

_INT = {"DAY", "MONTH", "DAY_OF_MONTH", "YEAR"}


def _schema(columns, kind: str) -> T.StructType:
    fields = [T.StructField("ID", T.StringType())] if kind == "id" else []
    for c in columns:
        if c in _INT:
            t = T.IntegerType()
        elif c == "PERIOD_START":
            t = T.DateType()
        elif c in HISTORY_COUNT_COLUMNS:
            t = T.LongType()
        else:
            t = T.DoubleType()
        fields.append(T.StructField(c, t))
    return T.StructType(fields)


OUTPUT_COLUMNS = {"daily": DAILY_COLUMNS, "monthly": MONTHLY_COLUMNS, "history": HISTORY_COLUMNS}


def scan_output_csv(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Read a ``write_station_csv`` output tree; blank fields become null.

    The ``PFX`` and ``ID`` partition directories become columns.
    """
    schema = T.StructType(_schema(OUTPUT_COLUMNS[kind], "plain").fields + [T.StructField("PFX", T.StringType()), T.StructField("ID", T.StringType())])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("basePath", root)
        .csv(root)
    )
    return df.select("ID", *OUTPUT_COLUMNS[kind])
