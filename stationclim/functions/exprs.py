"""Column-expression builders (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CJK_LANGUAGES, LABEL_DAY_SUFFIX, LABEL_MONTH_SUFFIX, LABEL_YEAR_SUFFIX, TENTHS_ELEMENTS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- dates

def parse_yyyymmdd(c: str | Column, strict: bool = True) -> Column:
    """``yyyymmdd`` text to date; strict parsing fails the job on bad text (ANSI)."""
    if strict:
        return F.to_date(col(c), "yyyyMMdd")
    return F.try_to_date(col(c), "yyyyMMdd")


def year_of(c: str | Column) -> Column:
    return F.year(col(c)).cast("int")


def month_of(c: str | Column) -> Column:
    return F.month(col(c)).cast("int")


def day_of_month(c: str | Column) -> Column:
    return F.dayofmonth(col(c)).cast("int")


def ordinal_day(c: str | Column) -> Column:
    return F.dayofyear(col(c)).cast("int")


def period_start(year: str | Column, month: str | Column) -> Column:
    """First day of the (year, month) period."""
    return F.make_date(col(year), col(month), F.lit(1))


def since(c: str | Column, cutoff) -> Column:
    """``DATE >= cutoff`` written as a literal range so it reaches the parquet scan."""
    return col(c) >= F.lit(cutoff)


def month_number(year: str | Column, month: str | Column) -> Column:
    """Months since year 0, for month arithmetic."""
    return col(year) * 12 + col(month)


# --------------------------------------------------------------------------- numbers

def nearest_rank(n: str | Column, q: float) -> Column:
    """0-based index of the nearest-rank ``q`` quantile among ``n`` sorted values.

    ``round`` here rounds half away from zero, matching the nearest
    interpolation of the original pipeline.
    """
    return F.round((col(n) - 1).cast("double") * F.lit(float(q))).cast("long")


def round2(c: str | Column) -> Column:
    """Round to 2 decimals, half to even on the scaled binary value."""
    return F.rint(col(c) * 100.0) / 100.0


def fmt2(c: str | Column) -> Column:
    """Two-decimal text; null stays null (written as an empty CSV field)."""
    return F.when(col(c).isNotNull(), F.format_string("%.2f", col(c)))


def scale_factor(element: str | Column) -> Column:
    """10.0 for tenth-unit elements, 1.0 otherwise."""
    return F.when(col(element).isin(*TENTHS_ELEMENTS), F.lit(10.0)).otherwise(F.lit(1.0))


def scale_tenths(element: str | Column, value: str | Column) -> Column:
    """Temperatures in tenths of a degree to degrees; precipitation unchanged."""
    return col(value).cast("double") / scale_factor(element)


# --------------------------------------------------------------------------- text

def strip_ws(c: str | Column) -> Column:
    """Strip leading / trailing whitespace (spaces, tabs, CR, LF, FF, VT)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def fixed_slice(c: str | Column, start: int, stop: int) -> Column:
    """0-based, end-exclusive character slice; short text gives ``''``."""
    return F.substring(col(c), start + 1, stop - start)


def starts_with_any(c: str | Column, prefixes: Iterable[str]) -> Column:
    cond = None
    for p in prefixes:
        term = col(c).startswith(p)
        cond = term if cond is None else (cond | term)
    return cond if cond is not None else F.lit(False)


def path_prefix(station_id: str | Column) -> Column:
    """First 3 characters of the ID, dropping a trailing ``0``."""
    sid = col(station_id)
    return F.when(F.substring(sid, 3, 1) == "0", F.substring(sid, 1, 2)).otherwise(F.substring(sid, 1, 3))


def is_finite(c: str | Column) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def date_label(kind: str, language: str, month: str | Column = "MONTH",
               day: str | Column = "DAY_OF_MONTH", year: str | Column = "YEAR") -> Column:
    """Chart point label: ``kind`` is daily, monthly or history."""
    m = col(month).cast("string")
    cjk = language in CJK_LANGUAGES
    if kind == "daily":
        if cjk:
            return F.concat(m, F.lit(LABEL_MONTH_SUFFIX), col(day).cast("string"), F.lit(LABEL_DAY_SUFFIX))
        return F.concat(m, F.lit("-"), col(day).cast("string"))
    if kind == "monthly":
        return F.concat(m, F.lit(LABEL_MONTH_SUFFIX)) if cjk else m
    if kind == "history":
        y = col(year).cast("string")
        if cjk:
            return F.concat(y, F.lit(LABEL_YEAR_SUFFIX), m, F.lit(LABEL_MONTH_SUFFIX))
        return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))
    raise ValueError(f"unknown label kind {kind!r}")
