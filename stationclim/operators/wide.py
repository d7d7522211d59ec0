"""Second aggregation path over wide per-station daily files.

Input: ``wide(STATION, DATE, TMIN_P10, TMAX_P90, TMIN_MIN, TMAX_MAX, PRCP_SUM)``
already in degrees.  Grouping is by the *ordinal* day of the year, so in
normal years March 1 shares day 60 with February 29 of leap years.

The inputs are arbitrary doubles, and a plain ``avg`` depends on the order in
which rows meet.  Means are therefore taken by exact binned sums
(``functions/exact.py``), which is the plain mean without its rounding errors:
the same for any partitioning, for any finite double, with NaN and infinities
as IEEE arithmetic has them.  Extremes ignore NaN unless there is nothing else.
With ``decimals=2`` results are what printing the double with two decimals shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import mean_by_bins, text_round2
from ..functions.exprs import day_of_month, month_of, ordinal_day, since
from ..schema import DEFAULT_CUTOFF, WIDE_DAILY_COLUMNS, WIDE_MONTHLY_COLUMNS

MEANS = ("TMIN_P10", "TMAX_P90", "PRCP_SUM")


def _grouped(wide: DataFrame, keys: dict[str, F.Column], extra: dict[str, F.Column], columns, decimals: int | None) -> DataFrame:
    """Means and extremes per group, in one pass; ``extra`` are expressions of the group's earliest ``DATE``."""
    if decimals not in (None, 2):
        raise ValueError("decimals must be None or 2")
    ends, out = {"_FIRST": (F.min, F.col("DATE"))}, dict(extra)
    for c, fn in (("TMIN_MIN", F.min), ("TMAX_MAX", F.max)):
        v = F.col(c).cast("double")
        ends |= {f"_ANY_{c}": (fn, v), f"_REAL_{c}": (fn, F.when(~F.isnan(v), v))}
        out[c] = F.coalesce(F.col(f"_REAL_{c}"), F.col(f"_ANY_{c}"))
    found = mean_by_bins(wide.withColumns(keys), list(keys), MEANS, ends).withColumns(out)
    kinds = {"TMIN_MIN", "TMAX_MAX", *MEANS}
    return found.select("ID", *[text_round2(F.col(c)).alias(c) if decimals and c in kinds else F.col(c) for c in columns])


def _since(wide: DataFrame, cutoff) -> DataFrame:
    return wide.where(since("DATE", cutoff)) if cutoff is not None else wide


def agg_wide_by_ordinal_day(wide: DataFrame, cutoff=DEFAULT_CUTOFF, decimals: int | None = None) -> DataFrame:
    """Per (station, ordinal day): means, extremes, and the calendar day of the earliest date.

    The calendar day reported for an ordinal day is that of its earliest
    date (deterministic, unlike first-in-file-order).
    """
    return _grouped(_since(wide, cutoff), {"ID": F.col("STATION"), "DAY": ordinal_day("DATE")},
                    {"MONTH": month_of("_FIRST"), "DAY_OF_MONTH": day_of_month("_FIRST")}, WIDE_DAILY_COLUMNS, decimals)


def agg_wide_by_month(wide: DataFrame, cutoff=DEFAULT_CUTOFF, decimals: int | None = None) -> DataFrame:
    """Per (station, calendar month): means and extremes."""
    return _grouped(_since(wide, cutoff), {"ID": F.col("STATION"), "MONTH": month_of("DATE")}, {}, WIDE_MONTHLY_COLUMNS, decimals)
