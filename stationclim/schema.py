"""Declared schemas, fixed values and output column orders.

Everything in the "fixed values" blocks must equal what the original
pipeline uses, otherwise outputs differ; they are stated here once, in
their natural order, and imported everywhere else.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the original pipeline)
# ---------------------------------------------------------------------------

# Observation elements, in output order.
ELEMENTS: tuple[str, ...] = ("TMIN", "TMAX", "PRCP")

# Elements stored in tenths of a degree C (divided by 10 for output).
# Precipitation is deliberately *not* scaled.
TENTHS_ELEMENTS: tuple[str, ...] = ("TMIN", "TMAX")

# Station-ID prefixes selected for processing.
STATION_PREFIXES: tuple[str, ...] = ("CHM", "JA", "KSM", "FRE", "GMM", "UKE", "IDM", "MXM")

# Climatology cut-off: observations before this date are ignored.
DEFAULT_CUTOFF = _dt.date(1970, 1, 1)

# Nearest-rank quantiles that are reported.
P10 = 0.1
P90 = 0.9

# Fixed-width station list: (column, 0-based start, end-exclusive stop).
STATION_CUTS: tuple[tuple[str, int, int], ...] = (
    ("ID", 0, 11),
    ("LATITUDE", 12, 20),
    ("LONGITUDE", 21, 30),
    ("ELEVATION", 31, 37),
    ("STATE", 38, 40),
    ("NAME", 41, 71),
    ("GSN_FLAG", 72, 75),
    ("HCN_CRN_FLAG", 76, 79),
    ("WMO_ID", 80, 85),
)

# Chart labels: suffixes used by the zh / ja date labels.
LABEL_YEAR_SUFFIX = "年"
LABEL_MONTH_SUFFIX = "月"
LABEL_DAY_SUFFIX = "日"
CJK_LANGUAGES: tuple[str, ...] = ("zh", "ja")

# Leap year the daily / monthly chart points are placed on.
CHART_BASE_YEAR = 2020

# Chart axis padding (degrees) around floor(min) / ceil(max).
AXIS_PAD = 2

# Maximum number of stations in one comparison.
MAX_COMPARE = 3

# ---------------------------------------------------------------------------
# Declared input schemas
# ---------------------------------------------------------------------------

RAW_OBS_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("DATE", T.StringType()),
        T.StructField("DATA_VALUE", T.LongType()),
    ]
)

MERGED_OBS_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("DATE", T.DateType()),
        T.StructField("DATA_VALUE", T.LongType()),
    ]
)

STATION_DOUBLE_COLUMNS = ("LATITUDE", "LONGITUDE", "ELEVATION")

STATION_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.DoubleType() if name in STATION_DOUBLE_COLUMNS else T.StringType(),
        )
        for name, _, _ in STATION_CUTS
    ]
)

WIDE_VALUE_COLUMNS = ("TMIN_P10", "TMAX_P90", "TMIN_MIN", "TMAX_MAX", "PRCP_SUM")

WIDE_SCHEMA = T.StructType(
    [T.StructField("DATE", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in WIDE_VALUE_COLUMNS]
)

# ---------------------------------------------------------------------------
# Output column orders (per station; the engine adds ID in front)
# ---------------------------------------------------------------------------

STATS = ("P10", "P90", "MIN", "MAX", "SUM")

DAILY_COLUMNS = (
    "DAY",
    "TMIN_P10",
    "TMAX_P90",
    "TMIN_MIN",
    "TMAX_MAX",
    "PRCP_SUM",
    "MONTH",
    "DAY_OF_MONTH",
)

MONTHLY_COLUMNS = ("MONTH", "TMIN_P10", "TMAX_P90", "TMIN_MIN", "TMAX_MAX", "PRCP_SUM")

HISTORY_VALUE_COLUMNS = tuple(f"{e}_{s}" for e in ELEMENTS for s in STATS)
HISTORY_COUNT_COLUMNS = tuple(f"{e}_ENTRY_COUNT" for e in ELEMENTS)
HISTORY_COLUMNS = ("PERIOD_START", "YEAR", "MONTH") + HISTORY_VALUE_COLUMNS + HISTORY_COUNT_COLUMNS

WIDE_DAILY_COLUMNS = ("DAY",) + WIDE_VALUE_COLUMNS + ("MONTH", "DAY_OF_MONTH")
WIDE_MONTHLY_COLUMNS = ("MONTH",) + WIDE_VALUE_COLUMNS

# Columns of the (tiny) chart value set.
CHART_TEMP_COLUMNS = ("TMAX_MAX", "TMIN_MIN", "TMAX_P90", "TMIN_P10")

# Chart variants: (max series column, min series column).
VARIANTS: dict[str, tuple[str, str]] = {
    "extreme": ("TMAX_MAX", "TMIN_MIN"),
    "percentile": ("TMAX_P90", "TMIN_P10"),
}
DEFAULT_VARIANT = "extreme"
