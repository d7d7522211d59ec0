"""Fixed-width station list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import fixed_slice, strip_ws
from ..schema import STATION_CUTS, STATION_DOUBLE_COLUMNS


def filter_blank_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.where(F.length(strip_ws(value)) > 0)


def parse_station_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """One text line per station -> 9 typed columns; blank lines skipped.

    Fields are cut by character offset and whitespace-stripped; absent text
    is ``""``.  Numeric fields are cast to double (ANSI: bad text fails).
    """
    cols = []
    for name, start, stop in STATION_CUTS:
        field = strip_ws(fixed_slice(value, start, stop))
        if name in STATION_DOUBLE_COLUMNS:
            field = field.cast("double")
        cols.append(field.alias(name))
    return filter_blank_lines(lines, value).select(*cols)


def scan_stations_fixed_width(spark: SparkSession, path: str) -> DataFrame:
    """Read the fixed-width station text file(s) at ``path``."""
    return parse_station_lines(spark.read.text(path))
