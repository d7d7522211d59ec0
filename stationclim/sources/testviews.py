"""Adapters that shape the driver's TPC-H-style tables into station data.

These are *test fixtures*, not part of the engine: they turn ``lineitem``
/ ``supplier`` / ``nation`` into observation, station-list and wide-file
inputs with the same schemas the engine reads in production.

Fixture rules (also used verbatim by the DuckDB oracle SQL):

* ID = one of ten 6-character prefixes picked by ``s_nationkey % 10``,
  followed by ``lpad(s_nationkey, 5, '0')``;
* DATE = ship date moved back 28 years (keeps leap days; spans 1967-1973
  so the 1970 cut-off matters);
* ELEMENT from the return flag: A -> TMIN, N -> TMAX, R -> PRCP;
* DATA_VALUE = ``quantity * 7 - 100``, null on line number 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture values (test data only).
ID_PREFIXES = ("CHM000", "JA0000", "KSM000", "FRE000", "GMM000", "UKE000", "IDM000", "MXM000", "JAW000", "USW000")
FLAG_TO_ELEMENT = {"A": "TMIN", "N": "TMAX", "R": "PRCP"}
SHIFT_MONTHS = -28 * 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def station_id(nationkey: str | Column) -> Column:
    nk = F.col(nationkey) if isinstance(nationkey, str) else nationkey
    prefixes = F.array(*[F.lit(p) for p in ID_PREFIXES])
    return F.concat(F.element_at(prefixes, (nk % 10 + 1).cast("int")), F.lpad(nk.cast("string"), 5, "0"))


def element_of(flag: str | Column) -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    expr = None
    for k, v in FLAG_TO_ELEMENT.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def t_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs(ID, ELEMENT, DATE, DATA_VALUE) from lineitem x supplier.

    ``supplier`` (two integer columns) is broadcast only after its row count
    (counted once per application; the test tables are read-only) is checked
    against ``MAX_BROADCAST_ROWS``; beyond that bound Spark plans a shuffle join.
    """
    from ..plans.sizing import broadcast_if_small, file_rows

    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_returnflag", "l_quantity", "l_linenumber"
    )
    supplier_path = f"{sf_dir.rstrip('/')}/supplier.parquet"
    su, _ = broadcast_if_small(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"),
                               rows=file_rows(spark, supplier_path))
    j = li.join(su, li.l_suppkey == su.s_suppkey)
    return j.select(
        station_id("s_nationkey").alias("ID"),
        element_of("l_returnflag").alias("ELEMENT"),
        F.add_months(F.col("l_shipdate").cast("date"), SHIFT_MONTHS).alias("DATE"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("long") * 7 - 100).alias("DATA_VALUE"),
    )


def t_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw layout: text dates, plus the hive partition columns STATION and ELEMENT."""
    o = t_obs(spark, sf_dir)
    return o.select(
        "ID",
        F.date_format("DATE", "yyyyMMdd").alias("DATE"),
        "DATA_VALUE",
        F.col("ID").alias("STATION"),
        "ELEMENT",
    )


def t_station_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width station lines, one per nation, plus one blank line per region.

    Latitude ``-60 + 5n``, longitude ``-170 + 14n``, elevation ``12.5n - 100``,
    state ``S<n % 7>`` for odd n else blank, name ``n_name``, GSN flag on
    even n, HCN flag on multiples of 3, WMO id ``lpad(n, 5)`` unless
    n % 4 == 1, in which case the line ends after the HCN field.
    """
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    state = F.when(k % 2 == 1, F.concat(F.lit("S"), (k % 7).cast("string"))).otherwise(F.lit(""))
    gsn = F.when(k % 2 == 0, F.lit("GSN")).otherwise(F.lit(""))
    hcn = F.when(k % 3 == 0, F.lit("HCN")).otherwise(F.lit(""))
    wmo = F.lpad(k.cast("string"), 5, "0")
    head = F.format_string(
        "%-11s %8.4f %9.4f %6.1f %-2s %-30s %-3s %-3s",
        station_id(k),
        (F.lit(-60.0) + k * 5.0),
        (F.lit(-170.0) + k * 14.0),
        (k * 12.5 - 100.0),
        state,
        F.col("n_name"),
        gsn,
        hcn,
    )
    line = F.when(k % 4 == 1, head).otherwise(F.concat(head, F.lit(" "), wmo))
    lines = n.select(line.alias("value"))
    # Column-dependent blanks (3 or 4 spaces), so the optimizer cannot fold the parse of them.
    blanks = table(spark, sf_dir, "region").select(F.expr("repeat(' ', 3 + r_regionkey % 2)").alias("value"))
    return lines.unionByName(blanks)


def t_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide per-station daily file: the per-date summary of ``t_obs``, all years.

    Columns STATION, DATE, TMIN_P10, TMAX_P90, TMIN_MIN, TMAX_MAX, PRCP_SUM.
    """
    from ..operators.climatology import day_histogram, year_day_summary

    yd = year_day_summary(day_histogram(t_obs(spark, sf_dir), cutoff=None))
    tenth = lambda e, c: F.when(F.col("ELEMENT") == e, F.col(c) / 10.0)
    wide = yd.groupBy("ID", "YEAR", "MONTH", "DAY_OF_MONTH").agg(
        F.max(tenth("TMIN", "P10")).alias("TMIN_P10"),
        F.max(tenth("TMAX", "P90")).alias("TMAX_P90"),
        F.max(tenth("TMIN", "MIN")).alias("TMIN_MIN"),
        F.max(tenth("TMAX", "MAX")).alias("TMAX_MAX"),
        F.max(F.when(F.col("ELEMENT") == "PRCP", F.col("SUM").cast("double"))).alias("PRCP_SUM"),
    )
    return wide.select(
        F.col("ID").alias("STATION"),
        F.make_date("YEAR", "MONTH", "DAY_OF_MONTH").alias("DATE"),
        "TMIN_P10",
        "TMAX_P90",
        "TMIN_MIN",
        "TMAX_MAX",
        "PRCP_SUM",
    )


def silent_station_id(regionkey: str = "r_regionkey") -> Column:
    return F.concat(F.lit("CHM000"), F.lpad((F.col(regionkey) + 90000).cast("string"), 5, "0"))


def t_silent_station_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more station line per region, of a station without any value; the line ends after the name."""
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(F.format_string(
        "%-11s %8.4f %9.4f %6.1f    %-30s", silent_station_id(), k * 10.0 - 20.0, k * 20.0 - 40.0, F.lit(10.0), F.col("r_name")).alias("value"))


def t_null_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region with an even key one observation without a value; the other silent stations have none at all."""
    k = F.col("r_regionkey")
    days = F.when(k % 2 == 0, F.array(F.lit("1971-03-05").cast("date"))).otherwise(F.array().cast("array<date>"))
    return table(spark, sf_dir, "region").select(
        silent_station_id().alias("ID"), F.lit("TMIN").alias("ELEMENT"), F.explode(days).alias("DATE"),
        F.lit(None).cast("long").alias("DATA_VALUE"))


def t_wide_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide per-station monthly file: the summary of each month of ``t_obs`` with a value, dated the first of the month."""
    from ..operators.climatology import month_histogram, year_month_summary

    ym = year_month_summary(month_histogram(t_obs(spark, sf_dir), cutoff=None))
    tenth = lambda e, c: F.when(F.col("ELEMENT") == e, F.col(c) / 10.0)
    return ym.groupBy(F.col("ID").alias("STATION"), F.col("PERIOD_START").alias("DATE")).agg(
        F.max(tenth("TMIN", "P10")).alias("TMIN_P10"),
        F.max(tenth("TMAX", "P90")).alias("TMAX_P90"),
        F.max(tenth("TMIN", "MIN")).alias("TMIN_MIN"),
        F.max(tenth("TMAX", "MAX")).alias("TMAX_MAX"),
        F.max(F.when(F.col("ELEMENT") == "PRCP", F.col("SUM").cast("double"))).alias("PRCP_SUM"),
    )


def t_seasonal_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of seasonal stations, from ``orders``: each station reports in some months of the year only.

    ID ``CHM000`` + ``lpad(70000 + o_custkey % 11, 5, '0')``; DATE the order date moved back 28 years, kept where
    ``(month * (o_custkey % 11 + 2)) % 5 < 2``; every order gives one value per element, ``o_orderkey % 300`` and 10 and 20 more.
    """
    k = F.col("o_custkey") % 11
    date = F.add_months(F.col("o_orderdate").cast("date"), SHIFT_MONTHS)
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit(ID_PREFIXES[0]), F.lpad((k + 70000).cast("string"), 5, "0")).alias("ID"), date.alias("DATE"),
        (F.col("o_orderkey") % 300).cast("long").alias("v"), k.alias("k")).where((F.month("DATE") * (F.col("k") + 2)) % 5 < 2)
    values = F.create_map(*[x for n, e in enumerate(FLAG_TO_ELEMENT.values()) for x in (F.lit(e), F.col("v") + 10 * n)])
    return o.select("ID", "DATE", F.explode(values).alias("ELEMENT", "DATA_VALUE")).select("ID", "ELEMENT", "DATE", "DATA_VALUE")
