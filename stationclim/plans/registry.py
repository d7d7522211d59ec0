"""Registered queries: operator id -> ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables in full through the fixture views in
``sources/testviews.py`` (observations from lineitem x supplier, station
lines from nation, wide files from the observations), so its work grows
with the data.  Sink / scan queries write to a fresh folder under the shared
checkpoint directory and return what they read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators import chart as ch
from ..operators import climatology as clim
from ..operators import stations as st
from ..operators import wide as wd
from ..operators.ordering import with_position
from ..plans import jobs
from ..schema import ELEMENTS, HISTORY_COLUMNS, STATS
from ..session import scratch_path
from ..sinks import bundles, writers
from ..sources import testviews as tv
from ..sources.observations import parse_obs_dates, scan_obs_merged, scan_obs_partitioned
from ..sources.outputs import scan_output_csv
from ..sources.stations import filter_blank_lines, parse_station_lines, scan_stations_fixed_width
from ..sources.wide import scan_wide_station_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixture parameters of individual queries.
BOUNDS = {"south": -40.0, "west": -150.0, "north": 40.0, "east": 150.0}
COMPARE_IDS = ("CHM00000000", "JA000000001", "KSM00000002")
ROUND_TIE_DIVISOR = 8.0  # v / 8 ends in .125 / .375 / ..., exact ties at 2 decimals


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


# --------------------------------------------------------------------------- shared inputs

def obs(spark, sf_dir) -> DataFrame:
    return tv.t_obs(spark, sf_dir)


def stations(spark, sf_dir) -> DataFrame:
    return parse_station_lines(tv.t_station_lines(spark, sf_dir))


def matched_stations(spark, sf_dir) -> DataFrame:
    return st.filter_station_prefix(stations(spark, sf_dir))


def obs_and_nulls(spark, sf_dir) -> DataFrame:
    """All observations, and those of stations whose values are all null."""
    return obs(spark, sf_dir).unionByName(tv.t_null_obs(spark, sf_dir))


def flagged_stations(spark, sf_dir) -> DataFrame:
    """Matched stations with MISSING; the listed stations without values have no monthly output, some no output at all."""
    extra = parse_station_lines(tv.t_silent_station_lines(spark, sf_dir))
    matched = matched_stations(spark, sf_dir).unionByName(st.filter_station_prefix(extra))
    return st.flag_missing_from_presence(matched, clim.output_presence(obs_and_nulls(spark, sf_dir)))


def day_summary(spark, sf_dir) -> DataFrame:
    return clim.year_day_summary(clim.day_histogram(obs(spark, sf_dir)))


def month_summary(spark, sf_dir) -> DataFrame:
    return clim.year_month_summary(clim.month_histogram(obs(spark, sf_dir)))


def write_raw(spark, sf_dir) -> str:
    path = scratch_path(spark, "raw")
    tv.t_raw(spark, sf_dir).write.partitionBy("STATION", "ELEMENT").parquet(path)
    return path


def write_merged(spark, sf_dir) -> str:
    raw = write_raw(spark, sf_dir)
    path = scratch_path(spark, "merged")
    jobs.merge_job(spark, raw, path)
    return path


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.select(
        *[X.round2(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


# --------------------------------------------------------------------------- 2.1 scans

@register("scan_obs_partitioned")
def q_scan_obs_partitioned(spark, sf_dir):
    return scan_obs_partitioned(spark, write_raw(spark, sf_dir))


@register("scan_obs_merged")
def q_scan_obs_merged(spark, sf_dir):
    return scan_obs_merged(spark, write_merged(spark, sf_dir))


@register("scan_stations_fixed_width")
def q_scan_stations_fixed_width(spark, sf_dir):
    path = scratch_path(spark, "stations")
    tv.t_station_lines(spark, sf_dir).write.text(path)
    return scan_stations_fixed_width(spark, path)


@register("scan_wide_station_file")
def q_scan_wide_station_file(spark, sf_dir):
    path = scratch_path(spark, "wide")
    tv.t_wide(spark, sf_dir).write.partitionBy("STATION").parquet(path)
    return scan_wide_station_file(spark, path)


@register("scan_output_csv")
def q_scan_output_csv(spark, sf_dir):
    path = scratch_path(spark, "monthly-csv")
    writers.write_station_csv(clim.monthly_output(obs(spark, sf_dir)), path, "monthly")
    return scan_output_csv(spark, path, "monthly")


# --------------------------------------------------------------------------- 2.2 sinks

@register("sink_merged_parquet")
def q_sink_merged_parquet(spark, sf_dir):
    path = write_merged(spark, sf_dir)
    return spark.read.parquet(path).select("ID", "ELEMENT", "DATE", "DATA_VALUE")


def _csv_roundtrip(spark, df: DataFrame, kind: str) -> DataFrame:
    path = scratch_path(spark, f"{kind}-csv")
    writers.write_station_csv(df, path, kind)
    cols = writers.COLUMNS[kind]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols] + [
        T.StructField("PFX", T.StringType()), T.StructField("ID", T.StringType())])
    back = spark.read.schema(schema).option("header", True).option("basePath", path).csv(path)
    return back.select("PFX", "ID", *cols)


@register("sink_daily_csv")
def q_sink_daily_csv(spark, sf_dir):
    return _csv_roundtrip(spark, clim.daily_output(obs(spark, sf_dir)), "daily")


@register("sink_monthly_csv")
def q_sink_monthly_csv(spark, sf_dir):
    return _csv_roundtrip(spark, clim.monthly_output(obs(spark, sf_dir)), "monthly")


@register("sink_history_csv")
def q_sink_history_csv(spark, sf_dir):
    return _csv_roundtrip(spark, clim.history_output(obs(spark, sf_dir)), "history")


SUMMARY_SCHEMA = "TMIN_raw_count bigint, TMAX_raw_count bigint, PRCP_raw_count bigint, monthly_history_rows bigint, PFX string, ID string"


@register("sink_summary_json")
def q_sink_summary_json(spark, sf_dir):
    out = jobs.station_outputs(obs(spark, sf_dir), stations(spark, sf_dir))
    frames = []
    for period, df in (("daily", out.daily_summary), ("monthly", out.monthly_summary)):
        path = scratch_path(spark, f"{period}-stats")
        writers.write_summary_json(df, path)
        back = spark.read.schema(SUMMARY_SCHEMA).option("basePath", path).json(path)
        frames.append(back.withColumn("PERIOD", F.lit(period)))
    return frames[0].unionByName(frames[1])


@register("sink_geojson")
def q_sink_geojson(spark, sf_dir):
    """The GeoJSON after a second run in ``ignore`` mode over a longer list, with observations of the new stations only.

    Stations that the first run wrote are not MISSING, though the second run has no rows for them.
    """
    path = scratch_path(spark, "geojson")
    jobs.run_stations(obs(spark, sf_dir), stations(spark, sf_dir), path)
    silent = parse_station_lines(tv.t_silent_station_lines(spark, sf_dir))
    out = jobs.run_stations(tv.t_null_obs(spark, sf_dir), stations(spark, sf_dir).unionByName(silent), path, mode="ignore")
    layer = f"{path}/{jobs.GEOJSON}"
    writers.write_geojson(st.geojson_features(out.stations), layer)
    return st.parse_features(writers.read_geojson_features(spark, layer))


@register("sink_mode")
def q_sink_mode(spark, sf_dir):
    """A run over the matched stations, then one in ``ignore`` mode over all stations, with other values of TMAX.

    What the first run has finished stays as it is; the other stations are computed from the other values.
    """
    path = scratch_path(spark, "mode")
    o = obs(spark, sf_dir)
    every = o.select("ID").distinct()
    jobs.run_stations(o, every, path, windows=("monthly",))
    value = F.when(F.col("DATA_VALUE").isNotNull(), F.month("DATE").cast("long") * 10)
    altered = o.withColumn("DATA_VALUE", F.when(F.col("ELEMENT") == "TMAX", value).otherwise(F.col("DATA_VALUE")))
    jobs.run_stations(altered, every, path, prefixes=("",), mode="ignore", windows=("monthly",))
    return scan_output_csv(spark, f"{path}/KIND=monthly", "monthly")


@register("sink_bundle_csv")
def q_sink_bundle_csv(spark, sf_dir):
    """The daily output of all stations from a run in the bundle layout."""
    path = scratch_path(spark, "bundles")
    o = obs(spark, sf_dir)
    jobs.run_stations(o, o.select("ID").distinct(), path, prefixes=("",), windows=("daily",), layout="bundle")
    return bundles.scan_bundle_csv(spark, path, "daily")


@register("sink_skip_empty")
def q_sink_skip_empty(spark, sf_dir):
    """Station directories written for the monthly output (no empty stations)."""
    path = scratch_path(spark, "skip-empty")
    writers.write_station_csv(clim.monthly_output(obs_and_nulls(spark, sf_dir)), path, "monthly")
    return scan_output_csv(spark, path, "monthly").select("ID").distinct()


# --------------------------------------------------------------------------- 2.3 projections / filters

@register("parse_date")
def q_parse_date(spark, sf_dir):
    raw = tv.t_raw(spark, sf_dir).select("ID", "ELEMENT", "DATE", "DATA_VALUE")
    return parse_obs_dates(raw)


@register("filter_from_1970")
def q_filter_from_1970(spark, sf_dir):
    return clim.filter_from(obs(spark, sf_dir))


@register("filter_not_null")
def q_filter_not_null(spark, sf_dir):
    return clim.filter_not_null(obs(spark, sf_dir))


@register("filter_station")
def q_filter_station(spark, sf_dir):
    return st.filter_station(obs(spark, sf_dir), matched_stations(spark, sf_dir))


@register("filter_station_prefix")
def q_filter_station_prefix(spark, sf_dir):
    return matched_stations(spark, sf_dir)


@register("filter_blank_lines")
def q_filter_blank_lines(spark, sf_dir):
    lines = filter_blank_lines(tv.t_station_lines(spark, sf_dir))
    return lines.select(X.strip_ws(X.fixed_slice("value", 0, 11)).alias("ID"), F.length("value").alias("LINE_LENGTH"))


@register("scale_tenths")
def q_scale_tenths(spark, sf_dir):
    o = obs(spark, sf_dir)
    return o.select("ID", "ELEMENT", "DATE", X.scale_tenths("ELEMENT", "DATA_VALUE").alias("VALUE"))


@register("date_parts")
def q_date_parts(spark, sf_dir):
    o = obs(spark, sf_dir)
    return clim.with_date_parts(o).withColumn("DAY_OF_YEAR", X.ordinal_day("DATE"))


@register("period_start")
def q_period_start(spark, sf_dir):
    o = clim.with_date_parts(obs(spark, sf_dir))
    return o.select("ID", "ELEMENT", "DATE", X.period_start("YEAR", "MONTH").alias("PERIOD_START"))


@register("round_2")
def q_round_2(spark, sf_dir):
    o = obs(spark, sf_dir)
    return o.select("ID", "ELEMENT", "DATE", X.round2(F.col("DATA_VALUE") / ROUND_TIE_DIVISOR).alias("VALUE"))


@register("station_path_prefix")
def q_station_path_prefix(spark, sf_dir):
    return st.with_path_prefix(stations(spark, sf_dir)).select("ID", "PFX")


@register("lookup_station")
def q_lookup_station(spark, sf_dir):
    return st.lookup_station(stations(spark, sf_dir), obs(spark, sf_dir).select("ID").distinct())


@register("filter_bounds")
def q_filter_bounds(spark, sf_dir):
    return st.filter_bounds(flagged_stations(spark, sf_dir), **BOUNDS)


@register("heat_points")
def q_heat_points(spark, sf_dir):
    return st.heat_points(flagged_stations(spark, sf_dir))


# --------------------------------------------------------------------------- 2.4 aggregations

@register("agg_nearest_quantile")
def q_agg_nearest_quantile(spark, sf_dir):
    return month_summary(spark, sf_dir).select(*clim.MONTH_KEYS, "P10", "P90")


@register("agg_year_day")
def q_agg_year_day(spark, sf_dir):
    return day_summary(spark, sf_dir)


@register("agg_daily_climatology")
def q_agg_daily_climatology(spark, sf_dir):
    return _round_doubles(clim.daily_climatology_long(day_summary(spark, sf_dir)))


@register("agg_year_month")
def q_agg_year_month(spark, sf_dir):
    return month_summary(spark, sf_dir)


@register("agg_monthly_history")
def q_agg_monthly_history(spark, sf_dir):
    ym = month_summary(spark, sf_dir)
    return ym.select(
        *clim.MONTH_KEYS, "PERIOD_START",
        *[X.round2(clim.scaled(s)).alias(s) for s in STATS],
        F.col("COUNT").alias("ENTRY_COUNT"),
    )


@register("agg_monthly_climatology")
def q_agg_monthly_climatology(spark, sf_dir):
    return _round_doubles(clim.monthly_climatology_long(month_summary(spark, sf_dir)))


@register("agg_raw_count")
def q_agg_raw_count(spark, sf_dir):
    return clim.raw_counts(obs(spark, sf_dir))


@register("agg_history_rows")
def q_agg_history_rows(spark, sf_dir):
    return clim.history_rows(clim.history_output(obs(spark, sf_dir)))


@register("agg_min_period_start")
def q_agg_min_period_start(spark, sf_dir):
    ym = month_summary(spark, sf_dir)
    return ym.groupBy("ID", "YEAR", "MONTH").agg(F.min("PERIOD_START").alias("PERIOD_START"))


@register("agg_wide_by_ordinal_day")
def q_agg_wide_by_ordinal_day(spark, sf_dir):
    return wd.agg_wide_by_ordinal_day(tv.t_wide(spark, sf_dir), decimals=2)


@register("agg_wide_by_month")
def q_agg_wide_by_month(spark, sf_dir):
    return wd.agg_wide_by_month(tv.t_wide_monthly(spark, sf_dir), decimals=2)


@register("agg_axis_bounds")
def q_agg_axis_bounds(spark, sf_dir):
    hist = clim.day_histogram(obs(spark, sf_dir))  # one exchange, reused by the three charts
    ym = clim.year_month_summary(clim.month_histogram_from_days(hist))
    parts = [
        ("daily", ch.chart_daily_series(clim.assemble_daily(clim.year_day_summary(hist), hist))),
        ("monthly", ch.chart_monthly_series(clim.assemble_monthly(ym))),
        ("history", ch.chart_history_series(clim.assemble_history(ym))),
    ]
    out = None
    for name, series in parts:
        b = ch.agg_axis_bounds(series).withColumn("CHART", F.lit(name))
        out = b if out is None else out.unionByName(b)
    return out


# --------------------------------------------------------------------------- 2.5 joins / set operations

@register("union_distinct_keys")
def q_union_distinct_keys(spark, sf_dir):
    return clim.union_distinct_keys(clim.with_date_parts(clim.filter_from(obs(spark, sf_dir))))


@register("rename_element_columns")
def q_rename_element_columns(spark, sf_dir):
    ym = month_summary(spark, sf_dir)
    out = None
    for e in ELEMENTS:
        one = clim.rename_element_columns(ym, e)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@register("existing_columns_only")
def q_existing_columns_only(spark, sf_dir):
    one = clim.rename_element_columns(month_summary(spark, sf_dir), "TMAX")
    return clim.existing_columns_only(one, ["ID", *HISTORY_COLUMNS])


def _combined(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(*clim.climatology_values())


@register("join_elements_daily")
def q_join_elements_daily(spark, sf_dir):
    return _round_doubles(_combined(day_summary(spark, sf_dir), ("ID", "MONTH", "DAY_OF_MONTH")))


@register("join_elements_monthly")
def q_join_elements_monthly(spark, sf_dir):
    return _round_doubles(_combined(month_summary(spark, sf_dir), ("ID", "MONTH")))


@register("join_elements_history")
def q_join_elements_history(spark, sf_dir):
    return clim.assemble_history(month_summary(spark, sf_dir)).drop("PERIOD_START")


@register("assemble_daily")
def q_assemble_daily(spark, sf_dir):
    return clim.daily_output(obs(spark, sf_dir))


@register("assemble_monthly")
def q_assemble_monthly(spark, sf_dir):
    return clim.monthly_output(obs(spark, sf_dir))


@register("assemble_history")
def q_assemble_history(spark, sf_dir):
    return clim.history_output(obs(spark, sf_dir))


@register("assemble_all_stations")
def q_assemble_all_stations(spark, sf_dir):
    """Every file of every matched station, as the job writes it: one row per line, without headers."""
    out = jobs.station_outputs(obs(spark, sf_dir), stations(spark, sf_dir), materialize="table")
    root = scratch_path(spark, "all-stations")
    try:
        jobs.write_station_outputs(out, root)
    finally:
        jobs.release(out)
    lines = spark.read.schema("LINE string, KIND string, PFX string, ID string").text(root)
    headers = [",".join(writers.COLUMNS[k]) for k in ("daily", "monthly", "history")]
    return lines.where(~F.col("LINE").isin(headers)).select("KIND", "PFX", "ID", "LINE")


@register("flag_missing")
def q_flag_missing(spark, sf_dir):
    return flagged_stations(spark, sf_dir)


@register("geojson_features")
def q_geojson_features(spark, sf_dir):
    return st.parse_features(st.geojson_features(flagged_stations(spark, sf_dir)))


@register("compare_stations")
def q_compare_stations(spark, sf_dir):
    return ch.compare_stations(clim.monthly_output(obs(spark, sf_dir)), COMPARE_IDS)


# --------------------------------------------------------------------------- 2.6 windows / sorts

@register("day_index")
def q_day_index(spark, sf_dir):
    return clim.daily_output(obs(spark, sf_dir)).select("ID", "MONTH", "DAY_OF_MONTH", "DAY")


@register("gap_flag_monthly")
def q_gap_flag_monthly(spark, sf_dir):
    """Stations that report all year, and seasonal ones whose charts break between months."""
    every = obs(spark, sf_dir).unionByName(tv.t_seasonal_obs(spark, sf_dir))
    return ch.chart_monthly_series(clim.monthly_output(every)).select("ID", "X", "GAP")


@register("gap_flag_history")
def q_gap_flag_history(spark, sf_dir):
    return ch.chart_history_series(clim.history_output(obs(spark, sf_dir))).select("ID", "X", "GAP")


@register("sort_obs")
def q_sort_obs(spark, sf_dir):
    """All observations with their place in the order of (ID, DATE); the other columns settle ties."""
    return with_position(obs(spark, sf_dir), ["ID", "DATE", "ELEMENT", "DATA_VALUE"])


@register("sort_outputs")
def q_sort_outputs(spark, sf_dir):
    return with_position(clim.history_output(obs(spark, sf_dir)), ["ID", "YEAR", "MONTH"])


# --------------------------------------------------------------------------- 2.7 chart tables

@register("chart_valid_rows")
def q_chart_valid_rows(spark, sf_dir):
    return ch.chart_valid_rows(clim.daily_output(obs(spark, sf_dir)))


@register("chart_daily_series")
def q_chart_daily_series(spark, sf_dir):
    return ch.chart_daily_series(clim.daily_output(obs(spark, sf_dir)))


@register("chart_monthly_series")
def q_chart_monthly_series(spark, sf_dir):
    return ch.chart_monthly_series(clim.monthly_output(obs(spark, sf_dir)))


@register("chart_history_series")
def q_chart_history_series(spark, sf_dir):
    return ch.chart_history_series(clim.history_output(obs(spark, sf_dir)))


@register("chart_variant")
def q_chart_variant(spark, sf_dir):
    return ch.chart_daily_series(clim.daily_output(obs(spark, sf_dir)), variant="percentile")


@register("chart_date_label")
def q_chart_date_label(spark, sf_dir):
    o = obs(spark, sf_dir)
    d = ch.chart_daily_series(clim.daily_output(o), language="ja").select("ID", "X", "LABEL")
    h = ch.chart_history_series(clim.history_output(o), language="zh").select("ID", "X", "LABEL")
    return d.withColumn("CHART", F.lit("daily")).unionByName(h.withColumn("CHART", F.lit("history")))


@register("month_ticks")
def q_month_ticks(spark, sf_dir):
    return ch.month_ticks(wd.agg_wide_by_ordinal_day(tv.t_wide(spark, sf_dir)))

