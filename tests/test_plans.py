"""Physical-plan checks: pushdown, pruning, shuffle count, no per-group lists."""

from __future__ import annotations

import datetime as dt

import pytest

from conftest import SF_SMALL
from stationclim.operators import climatology as clim
from stationclim.plans import inspect as pi
from stationclim.plans import jobs
from stationclim.sources import testviews as tv
from stationclim.sources.observations import scan_obs_merged


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    raw = str(root / "raw")
    tv.t_raw(spark, SF_SMALL).write.partitionBy("STATION", "ELEMENT").parquet(raw)
    out = str(root / "merged")
    jobs.merge_job(spark, raw, out)
    return out


def test_station_and_element_filters_reach_the_scan(spark, merged):
    df = scan_obs_merged(spark, merged, elements=["TMAX"], stations=["CHM00000000"])
    scan = pi.scan_nodes(df)[0]
    assert "ELEMENT" in scan["PartitionFilters"] and "TMAX" in scan["PartitionFilters"]
    assert "EqualTo(ID,CHM00000000)" in scan["PushedFilters"]


def test_cutoff_reaches_the_scan_and_columns_are_pruned(spark, merged):
    df = clim.raw_counts(scan_obs_merged(spark, merged), cutoff=dt.date(1970, 1, 1))
    scan = pi.scan_nodes(df)[0]
    assert "GreaterThanOrEqual(DATE,1970-01-01)" in scan["PushedFilters"]
    assert "IsNotNull(DATA_VALUE)" in scan["PushedFilters"]


def clusterings(df):
    """Keys of the plan's hash exchanges."""
    import re

    found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", pi.physical_plan(df))
    return [tuple(re.sub(r"#\d+L?", "", k).strip() for k in keys.split(",")[:-1]) for keys in found]


def test_daily_output_never_clusters_by_station_alone(spark, merged):
    df = clim.daily_output(scan_obs_merged(spark, merged))
    found = clusterings(df)
    assert ("ID", "MONTH") in found and all({"ID", "MONTH"} <= set(keys) for keys in found)
    assert not pi.uses_object_aggregate(df)  # no collect_list: per-group memory bounded by distinct values
    df.collect()
    final = pi.physical_plan(df)
    assert "ReusedExchange" in final  # the day numbers read the histogram that the climatology reads


def test_history_and_monthly_use_two_shuffles(spark, merged):
    for df in (clim.history_output(scan_obs_merged(spark, merged)), clim.monthly_output(scan_obs_merged(spark, merged))):
        assert pi.count_exchanges(df) == 2
        assert ("ID", "MONTH") in clusterings(df) and all({"ID", "MONTH"} <= set(keys) for keys in clusterings(df))


def test_month_roll_up_needs_no_extra_shuffle(spark, merged):
    h = clim.day_histogram(scan_obs_merged(spark, merged))
    df = clim.assemble_history(clim.year_month_summary(clim.month_histogram_from_days(h)))
    assert pi.count_exchanges(df) == 2


def test_station_semi_join_broadcast_is_size_checked(spark, merged):
    from stationclim.operators import stations as st
    from stationclim.plans import sizing

    ids = spark.createDataFrame([("CHM00000000",), ("JA000000001",)], "ID string")
    small = st.filter_station(scan_obs_merged(spark, merged), ids)
    assert "BroadcastHashJoin" in pi.physical_plan(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = st.filter_station(scan_obs_merged(spark, merged), ids, max_broadcast_rows=1)
        assert "BroadcastHashJoin" not in pi.physical_plan(big)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizing.broadcast_if_small(ids, max_rows=1)[1] is False


@pytest.mark.parametrize("materialize", ["cache", "table"])
def test_outputs_of_a_materialised_histogram(spark, merged, tmp_path, materialize):
    """The histogram keeps its (ID, MONTH) clustering: it is not shuffled again, only day numbers and counts are."""
    from stationclim.sinks import writers
    from stationclim.sources.stations import scan_stations_fixed_width

    tv.t_station_lines(spark, SF_SMALL).write.text(str(tmp_path / "st"))
    out = jobs.station_outputs(scan_obs_merged(spark, merged), scan_stations_fixed_width(spark, str(tmp_path / "st")),
                               materialize=materialize)
    try:
        for df in (out.monthly, out.history, out.month_raw, writers.month_level_lines(out.month_raw)):
            assert pi.count_exchanges(df) == 0
        assert pi.count_exchanges(out.daily) <= 1  # the day numbers
        if materialize == "table":  # (the text of a cached plan also shows how the cache was filled)
            assert set(clusterings(out.daily)) <= {("ID", "MONTH")}
        assert pi.physical_plan(writers.month_level_lines(out.month_raw)).count("Window") <= 4  # quantile and (ID, MONTH) windows
        exp = clim.daily_output(st_filter(spark, merged))
        assert out.daily.exceptAll(exp).count() == 0 and exp.exceptAll(out.daily).count() == 0
    finally:
        jobs.release(out)


def test_finished_stations_leave_before_the_histogram(spark, merged):
    """The anti join with the manifest stands below the aggregation of the observations."""
    ids = scan_obs_merged(spark, merged).select("ID").distinct()
    done = spark.createDataFrame([(k, "CHM", "CHM00000000", "r") for k in ("daily", "monthly")], "KIND string, PFX string, ID string, RUN string")
    out = jobs.station_outputs(scan_obs_merged(spark, merged), jobs.unfinished(ids, done))
    plan = pi.physical_plan(out.histogram)
    assert plan.index("HashAggregate") < plan.index("LeftSemi") < plan.index("LeftAnti")


def st_filter(spark, merged):
    from stationclim.operators import stations as st

    o = scan_obs_merged(spark, merged)
    return st.filter_station_prefix(o)


def test_no_python_and_no_cross_joins_in_any_registered_query(spark):
    from stationclim.plans import registry

    for name, q in registry.QUERIES.items():
        plan = pi.physical_plan(q(spark, SF_SMALL))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
                    "ObjectHashAggregate"):
            assert bad not in plan, (name, bad)
