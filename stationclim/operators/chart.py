"""Chart-ready tables computed from the assembled outputs.

Each table is keyed by ``ID``; windows are partitioned by ``ID`` and see at
most 366 (daily), 12 (monthly) or one row per history month per station.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import date_label, is_finite, month_number
from ..schema import AXIS_PAD, CHART_BASE_YEAR, CHART_TEMP_COLUMNS, DEFAULT_VARIANT, ELEMENTS, MAX_COMPARE, VARIANTS


def chart_valid_rows(df: DataFrame) -> DataFrame:
    """Rows whose four temperatures are finite; a missing precipitation is 0."""
    cond = None
    for c in CHART_TEMP_COLUMNS:
        cond = is_finite(c) if cond is None else (cond & is_finite(c))
    prcp = F.when(is_finite("PRCP_SUM") & (F.col("PRCP_SUM") != 0), F.col("PRCP_SUM")).otherwise(F.lit(0.0))
    return df.where(cond).withColumn("PRCP_SUM", prcp.cast("double"))


def variant_columns(variant: str = DEFAULT_VARIANT) -> tuple[str, str]:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; expected one of {sorted(VARIANTS)}")
    return VARIANTS[variant]


def _series(df: DataFrame, variant: str) -> list[F.Column]:
    hi, lo = variant_columns(variant)
    return [F.col(hi).alias("MAX_TEMP"), F.col(lo).alias("MIN_TEMP"), F.col("PRCP_SUM").alias("PRCP")]


def chart_daily_series(daily: DataFrame, variant: str = DEFAULT_VARIANT, language: str = "en") -> DataFrame:
    """Daily points on leap year 2020, with the chosen temperature pair."""
    v = chart_valid_rows(daily)
    return v.select(
        "ID",
        F.make_date(F.lit(CHART_BASE_YEAR), F.col("MONTH"), F.col("DAY_OF_MONTH")).alias("X"),
        *_series(v, variant),
        date_label("daily", language).alias("LABEL"),
    )


def chart_monthly_series(monthly: DataFrame, variant: str = DEFAULT_VARIANT, language: str = "en") -> DataFrame:
    """Monthly points on 2020-MM-01; ``GAP`` marks a segment spanning > 1 month."""
    v = chart_valid_rows(monthly)
    w = Window.partitionBy("ID").orderBy("MONTH")
    return v.select(
        "ID",
        F.make_date(F.lit(CHART_BASE_YEAR), F.col("MONTH"), F.lit(1)).alias("X"),
        *_series(v, variant),
        date_label("monthly", language).alias("LABEL"),
        F.coalesce((F.col("MONTH") - F.lag("MONTH").over(w)) > 1, F.lit(False)).alias("GAP"),
    )


def chart_history_series(history: DataFrame, variant: str = DEFAULT_VARIANT, language: str = "en") -> DataFrame:
    """History points on PERIOD_START; counts default to 0; ``GAP`` after filtering."""
    h = history.where(F.col("PERIOD_START").isNotNull())
    for e in ELEMENTS:
        h = h.withColumn(f"{e}_ENTRY_COUNT", F.coalesce(F.col(f"{e}_ENTRY_COUNT"), F.lit(0).cast("long")))
    v = chart_valid_rows(h)
    mn = month_number("YEAR", "MONTH")
    w = Window.partitionBy("ID").orderBy("PERIOD_START")
    return v.select(
        "ID",
        F.col("PERIOD_START").alias("X"),
        "YEAR",
        "MONTH",
        *_series(v, variant),
        *[f"{e}_ENTRY_COUNT" for e in ELEMENTS],
        date_label("history", language).alias("LABEL"),
        F.coalesce(F.abs(mn - F.lag(mn).over(w)) > 1, F.lit(False)).alias("GAP"),
    )


def agg_axis_bounds(series: DataFrame) -> DataFrame:
    """Per station: ``floor(min) - 2`` and ``ceil(max) + 2`` over both temperature series."""
    return series.groupBy("ID").agg(
        (F.floor(F.least(F.min("MAX_TEMP"), F.min("MIN_TEMP"))) - AXIS_PAD).cast("long").alias("Y_MIN"),
        (F.ceil(F.greatest(F.max("MAX_TEMP"), F.max("MIN_TEMP"))) + AXIS_PAD).cast("long").alias("Y_MAX"),
    )


def month_ticks(daily_by_ordinal: DataFrame) -> DataFrame:
    """Axis ticks of the ordinal-day chart: rows on the 1st of a month, label ``M/1``."""
    return daily_by_ordinal.where(F.col("DAY_OF_MONTH") == 1).select(
        "ID", F.col("DAY").alias("TICK"), F.concat(F.col("MONTH").cast("string"), F.lit("/1")).alias("TICK_LABEL")
    )


def compare_stations(monthly: DataFrame, ids: Sequence[str], tab: str = "temperature",
                     variant: str = DEFAULT_VARIANT) -> DataFrame:
    """Up to three distinct stations' monthly series aligned on MONTH.

    ``tab`` = ``temperature`` gives ``<ID>_MAX_TEMP`` / ``<ID>_MIN_TEMP`` per
    station, ``precipitation`` gives ``<ID>_PRCP``.
    """
    uniq = list(dict.fromkeys(ids))
    if len(uniq) > MAX_COMPARE:
        raise ValueError(f"at most {MAX_COMPARE} stations can be compared, got {len(uniq)}")
    if not uniq:
        raise ValueError("no station selected")
    hi, lo = variant_columns(variant)
    v = chart_valid_rows(monthly.where(F.col("ID").isin(*uniq)))
    if tab == "temperature":
        aggs = [F.first(hi).alias("MAX_TEMP"), F.first(lo).alias("MIN_TEMP")]
    elif tab == "precipitation":
        aggs = [F.first("PRCP_SUM").alias("PRCP")]
    else:
        raise ValueError(f"unknown tab {tab!r}")
    out = v.groupBy("MONTH").pivot("ID", uniq).agg(*aggs)
    if len(aggs) == 1:  # a single aggregate is named by the pivot value alone
        out = out.withColumnsRenamed({i: f"{i}_PRCP" for i in uniq})
    return out
