"""Year-level summaries, climatologies and the assembled station outputs.

Input everywhere is the long observation frame
``obs(ID string, ELEMENT string, DATE date, DATA_VALUE bigint)``; every
operator is keyed by ``ID`` so one call serves one station or all of them.

Shuffle plan (see ``plans/inspect.py`` for the checks):

1. partial aggregation to the value histogram, shuffled on its full key;
2. one shuffle of the histogram on ``(ID, MONTH)``.

Everything after that -- quantile ranking, year-level summary, the
climatology, the element pivot and the monthly branch -- is keyed by a
superset of ``(ID, MONTH)`` and runs inside those partitions.  The ``DAY``
number crosses months; it needs one more shuffle, again on ``(ID, MONTH)``, of
at most 12 x 12 rows a station (``day_numbers``).  So one station is the work of
up to twelve tasks, and per (station, month) the histogram is bounded by
calendar days x elements x distinct values, however many rows are duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import day_of_month, month_of, period_start, round2, scale_factor, since, year_of
from ..schema import (
    DAILY_COLUMNS,
    DEFAULT_CUTOFF,
    ELEMENTS,
    HISTORY_COLUMNS,
    MONTHLY_COLUMNS,
    STATS,
    TENTHS_ELEMENTS,
)
from .summarize import summarize_histogram, value_histogram

DAY_KEYS = ("ID", "ELEMENT", "YEAR", "MONTH", "DAY_OF_MONTH")
MONTH_KEYS = ("ID", "ELEMENT", "YEAR", "MONTH")
CLUSTER = ("ID", "MONTH")  # every step after the histogram is keyed by a superset of these


# --------------------------------------------------------------------------- filters

def filter_from(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    """Keep observations on or after ``cutoff`` (pushed to the scan as a date range)."""
    if cutoff is None:
        return obs
    return obs.where(since("DATE", cutoff))


def filter_not_null(obs: DataFrame, value: str = "DATA_VALUE") -> DataFrame:
    return obs.where(F.col(value).isNotNull())


def with_date_parts(obs: DataFrame, date: str = "DATE") -> DataFrame:
    return obs.withColumns(
        {"YEAR": year_of(date), "MONTH": month_of(date), "DAY_OF_MONTH": day_of_month(date)}
    )


# --------------------------------------------------------------------------- histograms

def day_histogram(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    """Value histogram per (station, element, calendar date), nulls kept, clustered by (ID, MONTH)."""
    base = with_date_parts(filter_from(obs, cutoff)).select(*DAY_KEYS, "DATA_VALUE")
    return value_histogram(base, DAY_KEYS).repartition(*CLUSTER)


def month_histogram(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    """Value histogram per (station, element, year, month), nulls dropped, clustered by (ID, MONTH)."""
    base = with_date_parts(filter_not_null(filter_from(obs, cutoff))).select(*MONTH_KEYS, "DATA_VALUE")
    return value_histogram(base, MONTH_KEYS).repartition(*CLUSTER)


def month_histogram_from_days(day_hist: DataFrame) -> DataFrame:
    """Roll a day histogram up to months (no shuffle if ``day_hist`` is clustered by (ID, MONTH))."""
    return (
        day_hist.where(F.col("DATA_VALUE").isNotNull())
        .groupBy(*MONTH_KEYS, "DATA_VALUE")
        .agg(F.sum("C").alias("C"))
    )


# --------------------------------------------------------------------------- year level

def year_day_summary(day_hist: DataFrame) -> DataFrame:
    """Per (ID, ELEMENT, YEAR, MONTH, DAY_OF_MONTH): P10, P90, MIN, MAX, SUM, COUNT.

    Values stay in stored units (integer tenths for temperatures).  A day
    whose values are all null keeps its row, with null quantiles / extremes
    and ``SUM`` = 0.
    """
    return summarize_histogram(day_hist, DAY_KEYS, null_sum_as_zero=True)


def year_month_summary(month_hist: DataFrame) -> DataFrame:
    """Per (ID, ELEMENT, YEAR, MONTH) of non-null values, plus ``PERIOD_START``."""
    s = summarize_histogram(month_hist, MONTH_KEYS)
    return s.withColumn("PERIOD_START", period_start("YEAR", "MONTH"))


def scaled(c: str, element: str = "ELEMENT") -> F.Column:
    return F.col(c) / scale_factor(element)


def daily_climatology_long(yd: DataFrame) -> DataFrame:
    """Per (ID, ELEMENT, MONTH, DAY_OF_MONTH): mean P10 / P90 / SUM over years, min, max."""
    g = yd.groupBy("ID", "ELEMENT", "MONTH", "DAY_OF_MONTH").agg(
        F.avg("P10").alias("P10"),
        F.avg("P90").alias("P90"),
        F.min("MIN").alias("MIN"),
        F.max("MAX").alias("MAX"),
        F.avg("SUM").alias("SUM"),
    )
    return g.select("ID", "ELEMENT", "MONTH", "DAY_OF_MONTH", *[scaled(s).alias(s) for s in STATS])


def monthly_climatology_long(ym: DataFrame) -> DataFrame:
    """Per (ID, ELEMENT, MONTH): the climatology over the year-month summary."""
    g = ym.groupBy("ID", "ELEMENT", "MONTH").agg(
        F.avg("P10").alias("P10"),
        F.avg("P90").alias("P90"),
        F.min("MIN").alias("MIN"),
        F.max("MAX").alias("MAX"),
        F.avg("SUM").alias("SUM"),
    )
    return g.select("ID", "ELEMENT", "MONTH", *[scaled(s).alias(s) for s in STATS])


# --------------------------------------------------------------------------- keys and column shapes

def union_distinct_keys(parts: DataFrame) -> DataFrame:
    """Keys of all elements, from one read of observations with date parts.

    LEVEL ``day`` (MONTH, DAY_OF_MONTH; days without a value count), ``month``
    (MONTH) and ``year_month`` (YEAR, MONTH), the last two of months with a
    value; other key columns are null.
    """
    none = F.lit(None).cast("int")

    def key(level, year, month, day):
        return F.struct(F.lit(level).alias("LEVEL"), year.alias("YEAR"), month.alias("MONTH"), day.alias("DAY_OF_MONTH"))

    y, m, d = F.col("YEAR"), F.col("MONTH"), F.col("DAY_OF_MONTH")
    day = F.array(key("day", none, m, d))
    month = F.array(key("month", none, m, none), key("year_month", y, m, none))
    keys = F.when(F.col("DATA_VALUE").isNull(), day).otherwise(F.concat(day, month))
    return parts.select("ID", F.explode(keys).alias("_k")).select("ID", "_k.*").distinct()


def rename_element_columns(ym: DataFrame, element: str) -> DataFrame:
    """Rows of one element with its statistics named ``<element>_<statistic>``."""
    return ym.where(F.col("ELEMENT") == element).select(
        "ID", "PERIOD_START", "YEAR", "MONTH", *[F.col(s).alias(f"{element}_{s}") for s in STATS],
        F.col("COUNT").alias(f"{element}_ENTRY_COUNT"))


def existing_columns_only(df: DataFrame, wanted) -> DataFrame:
    """The columns of ``wanted`` that ``df`` has, in the order of ``wanted``."""
    return df.select(*[c for c in wanted if c in df.columns])


# --------------------------------------------------------------------------- element pivot

def _of(element: str, c: str) -> F.Column:
    return F.when(F.col("ELEMENT") == element, F.col(c))


def _div(element: str) -> float:
    return 10.0 if element in TENTHS_ELEMENTS else 1.0


def climatology_values() -> list[F.Column]:
    """The five reported climatology columns as conditional aggregates."""
    return [
        (F.avg(_of("TMIN", "P10")) / _div("TMIN")).alias("TMIN_P10"),
        (F.avg(_of("TMAX", "P90")) / _div("TMAX")).alias("TMAX_P90"),
        (F.min(_of("TMIN", "MIN")) / _div("TMIN")).alias("TMIN_MIN"),
        (F.max(_of("TMAX", "MAX")) / _div("TMAX")).alias("TMAX_MAX"),
        (F.avg(_of("PRCP", "SUM")) / _div("PRCP")).alias("PRCP_SUM"),
    ]


def day_numbers(day_hist: DataFrame) -> DataFrame:
    """(ID, MONTH, DAYS, BEFORE): the calendar days present in a month as bits, and how many the months before have.

    Each month tells the later ones how many days it has, so that the sums are
    made by (ID, MONTH) and no task needs a whole station.
    """
    # The comparison always holds.  It reads every column, so that this branch and the climatology share one exchange
    # of the histogram instead of each pruning it in its own way.
    whole_row = F.xxhash64(*day_hist.columns) >= F.lit(-(2**63))
    known = day_hist.where(F.col("ID").isNotNull() & F.col("MONTH").isNotNull())  # as the join implies for the other branch
    bits = known.groupBy("ID", "MONTH").agg(F.bit_or(F.when(whole_row, F.expr("shiftleft(1L, DAY_OF_MONTH)"))).alias("DAYS"))
    n = F.bit_count("DAYS").cast("long")
    own = F.array(F.struct(F.col("MONTH").alias("MONTH"), F.col("DAYS").alias("DAYS"), F.lit(0).cast("long").alias("N")))
    later = F.transform(
        F.filter(F.array(*[F.lit(m) for m in range(1, 13)]), lambda m: m > F.col("MONTH")),
        lambda m: F.struct(m.alias("MONTH"), F.lit(0).cast("long").alias("DAYS"), n.alias("N")))
    told = bits.select("ID", F.explode(F.concat(own, later)).alias("_t")).select("ID", "_t.*")
    return told.groupBy("ID", "MONTH").agg(F.bit_or("DAYS").alias("DAYS"), F.sum("N").alias("BEFORE"))


def assemble_daily(yd: DataFrame, day_hist: DataFrame) -> DataFrame:
    """Daily climatology of every station: keys are the union over elements.

    ``yd`` is the ``year_day_summary`` of ``day_hist``.  ``DAY`` numbers a station's
    calendar days from 1: the days of the months before, and the days up to this
    one within the month.
    """
    combined = yd.groupBy("ID", "MONTH", "DAY_OF_MONTH").agg(*climatology_values())
    upto = F.col("DAYS").bitwiseAND(F.expr("shiftleft(2L, DAY_OF_MONTH) - 1L"))
    out = combined.join(day_numbers(day_hist), ["ID", "MONTH"]).withColumn(
        "DAY", (F.col("BEFORE") + F.bit_count(upto)).cast("int"))
    return out.select(
        "ID",
        *[round2(c).alias(c) if c not in ("DAY", "MONTH", "DAY_OF_MONTH") else F.col(c) for c in DAILY_COLUMNS],
    )


def assemble_monthly(ym: DataFrame) -> DataFrame:
    """Monthly climatology of every station (months with any non-null value)."""
    combined = ym.groupBy("ID", "MONTH").agg(*climatology_values())
    return combined.select(
        "ID", *[F.col(c) if c == "MONTH" else round2(c).alias(c) for c in MONTHLY_COLUMNS]
    )


def assemble_history(ym: DataFrame) -> DataFrame:
    """Month-by-month history with all 15 value and 3 count columns.

    Temperatures and quantiles are doubles in degrees; precipitation
    extremes and totals stay integers.  A count is null when the element has
    no value that month.
    """
    aggs = []
    for e in ELEMENTS:
        for s in STATS:
            if e in TENTHS_ELEMENTS or s in ("P10", "P90"):
                fn = {"P10": F.max, "P90": F.max, "MIN": F.min, "MAX": F.max, "SUM": F.sum}[s]
                aggs.append(round2(fn(_of(e, s)) / _div(e)).alias(f"{e}_{s}"))
            else:
                fn = {"MIN": F.min, "MAX": F.max, "SUM": F.sum}[s]
                aggs.append(fn(_of(e, s)).alias(f"{e}_{s}"))
    aggs += [F.sum(_of(e, "COUNT")).alias(f"{e}_ENTRY_COUNT") for e in ELEMENTS]
    combined = ym.groupBy("ID", "YEAR", "MONTH").agg(*aggs)
    combined = combined.withColumn("PERIOD_START", period_start("YEAR", "MONTH"))
    return combined.select("ID", *HISTORY_COLUMNS)


def month_level_raw(ym: DataFrame) -> DataFrame:
    """Per (ID, YEAR, MONTH): every element's P10/P90/MIN/MAX/SUM in stored integer units, and counts.

    The common input of the history (a projection of it) and of the monthly
    climatology (an average over years of it); a missing element is null.
    """
    aggs = []
    for e in ELEMENTS:
        aggs += [F.max(_of(e, s)).alias(f"{e}_{s}") for s in STATS]
    aggs += [F.sum(_of(e, "COUNT")).alias(f"{e}_ENTRY_COUNT") for e in ELEMENTS]
    return ym.groupBy("ID", "YEAR", "MONTH").agg(*aggs)


def history_values(raw: DataFrame | None = None) -> dict[str, F.Column]:
    """History columns (as in ``assemble_history``) as expressions over ``month_level_raw``."""
    out = {"PERIOD_START": period_start("YEAR", "MONTH"), "YEAR": F.col("YEAR"), "MONTH": F.col("MONTH")}
    for e in ELEMENTS:
        for s in STATS:
            c = f"{e}_{s}"
            if e in TENTHS_ELEMENTS or s in ("P10", "P90"):
                out[c] = round2(F.col(c) / _div(e))
            else:
                out[c] = F.col(c)
    for e in ELEMENTS:
        out[f"{e}_ENTRY_COUNT"] = F.col(f"{e}_ENTRY_COUNT")
    return out


def monthly_values_over(w) -> dict[str, F.Column]:
    """Monthly climatology columns as window aggregates over ``month_level_raw`` rows of one (ID, MONTH)."""
    return {
        "MONTH": F.col("MONTH"),
        "TMIN_P10": round2(F.avg("TMIN_P10").over(w) / _div("TMIN")),
        "TMAX_P90": round2(F.avg("TMAX_P90").over(w) / _div("TMAX")),
        "TMIN_MIN": round2(F.min("TMIN_MIN").over(w) / _div("TMIN")),
        "TMAX_MAX": round2(F.max("TMAX_MAX").over(w) / _div("TMAX")),
        "PRCP_SUM": round2(F.avg("PRCP_SUM").over(w) / _div("PRCP")),
    }


# --------------------------------------------------------------------------- counts

def raw_counts(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    """Per station: non-null observations since ``cutoff`` for each element."""
    base = filter_not_null(filter_from(obs, cutoff))
    return base.groupBy("ID").agg(
        *[F.count_if(F.col("ELEMENT") == e).alias(f"{e}_raw_count") for e in ELEMENTS]
    )


def raw_counts_from_history(history: DataFrame) -> DataFrame:
    """Same numbers as ``raw_counts``, from the history's entry counts."""
    return history.groupBy("ID").agg(
        *[F.coalesce(F.sum(f"{e}_ENTRY_COUNT"), F.lit(0).cast("long")).alias(f"{e}_raw_count") for e in ELEMENTS]
    )


def output_presence(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    """Per station: whether it gets a daily and a monthly output.

    By construction a station has daily rows iff it has any observation
    since ``cutoff`` (null values included) and monthly rows iff it has a
    non-null one, so one partial aggregate answers both without building the
    outputs.
    """
    return filter_from(obs, cutoff).groupBy("ID").agg(
        (F.count(F.lit(1)) > 0).alias("HAS_DAILY"),
        (F.count("DATA_VALUE") > 0).alias("HAS_MONTHLY"),
    )


def summary_counts(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    """Per station with any observation since ``cutoff``: non-null counts per element (0 if none).

    Unlike ``raw_counts`` a station whose values are all null keeps its row
    (it has a daily output, so it gets a daily summary).
    """
    nonnull = F.col("DATA_VALUE").isNotNull()
    return filter_from(obs, cutoff).groupBy("ID").agg(
        *[F.count_if(nonnull & (F.col("ELEMENT") == e)).alias(f"{e}_raw_count") for e in ELEMENTS]
    )


def history_rows_from_obs(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    """``history_rows`` from the observations: distinct (YEAR, MONTH) with a non-null value."""
    months = with_date_parts(filter_not_null(filter_from(obs, cutoff))).select("ID", "YEAR", "MONTH").distinct()
    return months.groupBy("ID").agg(F.count(F.lit(1)).alias("monthly_history_rows"))


def history_rows_from_histogram(day_hist: DataFrame) -> DataFrame:
    """``history_rows`` without building the history: distinct (YEAR, MONTH) with a non-null value."""
    months = day_hist.where(F.col("DATA_VALUE").isNotNull()).select("ID", "YEAR", "MONTH").distinct()
    return months.groupBy("ID").agg(F.count(F.lit(1)).alias("monthly_history_rows"))


def history_rows(history: DataFrame) -> DataFrame:
    return history.groupBy("ID").agg(F.count(F.lit(1)).alias("monthly_history_rows"))


# --------------------------------------------------------------------------- one-call helpers

def daily_output(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    hist = day_histogram(obs, cutoff)
    return assemble_daily(year_day_summary(hist), hist)


def monthly_output(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    return assemble_monthly(year_month_summary(month_histogram(obs, cutoff)))


def history_output(obs: DataFrame, cutoff=DEFAULT_CUTOFF) -> DataFrame:
    return assemble_history(year_month_summary(month_histogram(obs, cutoff)))
