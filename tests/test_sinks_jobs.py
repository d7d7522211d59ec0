"""Round trips of the sinks and the end-to-end jobs."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stationclim.operators import climatology as clim
from stationclim.operators import stations as st
from stationclim.operators import wide as wd
from stationclim.plans import jobs
from stationclim.sinks import writers
from stationclim.sources import testviews as tv
from stationclim.sources.observations import scan_obs_merged
from stationclim.sources.outputs import scan_output_csv
from stationclim.sources.wide import scan_wide_station_file


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    raw, merged, lines = str(root / "raw"), str(root / "merged"), str(root / "stations")
    tv.t_raw(spark, SF_SMALL).write.partitionBy("STATION", "ELEMENT").parquet(raw)
    tv.t_station_lines(spark, SF_SMALL).write.text(lines)
    jobs.merge_job(spark, raw, merged)
    return {"root": root, "raw": raw, "merged": merged, "stations": lines}


def test_merged_files_are_sorted_and_complete(spark, layout):
    o = tv.t_obs(spark, SF_SMALL)
    m = scan_obs_merged(spark, layout["merged"])
    assert m.exceptAll(o).count() == 0 and o.exceptAll(m).count() == 0
    for f in glob.glob(os.path.join(layout["merged"], "ELEMENT=*", "*.parquet")):
        rows = [(r.ID, r.DATE) for r in spark.read.parquet(f).select("ID", "DATE").collect()]
        assert rows == sorted(rows)


def test_csv_round_trip(spark, tmp_path):
    out = clim.monthly_output(tv.t_obs(spark, SF_SMALL))
    writers.write_station_csv(out, str(tmp_path / "m"), "monthly")
    back = scan_output_csv(spark, str(tmp_path / "m"), "monthly")
    assert back.exceptAll(out).count() == 0 and out.exceptAll(back).count() == 0
    files = glob.glob(str(tmp_path / "m" / "PFX=*" / "ID=*" / "part-*"))
    assert files and all(open(f).readline().strip() == "MONTH,TMIN_P10,TMAX_P90,TMIN_MIN,TMAX_MAX,PRCP_SUM" for f in files)
    assert len(files) == out.select("ID").distinct().count()  # one file per station


def test_sink_mode_ignore_keeps_existing(spark, tmp_path):
    out = clim.monthly_output(tv.t_obs(spark, SF_SMALL))
    path = str(tmp_path / "m")
    writers.write_station_csv(out, path, "monthly")
    writers.write_station_csv(out.where(F.col("MONTH") == 1), path, "monthly", mode="ignore")
    assert scan_output_csv(spark, path, "monthly").count() == out.count()
    # dynamic overwrite replaces only the stations present in the new data
    one = out.where(F.col("ID") == out.first().ID).where(F.col("MONTH") == 1)
    writers.write_station_csv(one, path, "monthly", mode="overwrite")
    back = scan_output_csv(spark, path, "monthly")
    assert back.count() == out.count() - out.where(F.col("ID") == out.first().ID).count() + 1


def test_wide_file_round_trip(spark, tmp_path):
    w = tv.t_wide(spark, SF_SMALL)
    w.write.partitionBy("STATION").parquet(str(tmp_path / "w"))
    back = scan_wide_station_file(spark, str(tmp_path / "w"))
    assert back.exceptAll(w).count() == 0 and w.exceptAll(back).count() == 0


def test_all_stations_job(spark, layout):
    out_root = str(layout["root"] / "out")
    out = jobs.all_stations_job(spark, layout["merged"], layout["stations"], out_root)
    daily = scan_output_csv(spark, f"{out_root}/KIND=daily", "daily")
    obs = tv.t_obs(spark, SF_SMALL)
    expected = st.filter_station(clim.daily_output(obs), st.filter_station_prefix(obs.select("ID")))
    assert daily.exceptAll(expected).count() == 0 and expected.exceptAll(daily).count() == 0
    hist = scan_output_csv(spark, f"{out_root}/KIND=monthly-history", "history")
    matched_ids = st.filter_station_prefix(obs.select("ID"))
    exp_hist = st.filter_station(clim.history_output(obs), matched_ids)
    assert hist.exceptAll(exp_hist).count() == 0 and exp_hist.exceptAll(hist).count() == 0
    mon = scan_output_csv(spark, f"{out_root}/KIND=monthly", "monthly")
    exp_mon = st.filter_station(clim.monthly_output(obs), matched_ids)
    assert mon.exceptAll(exp_mon).count() == 0 and exp_mon.exceptAll(mon).count() == 0
    for kind, first in (("monthly", "MONTH,"), ("monthly-history", "PERIOD_START,"), ("daily", "DAY,")):
        files = glob.glob(f"{out_root}/KIND={kind}/PFX=*/ID=*/part-*")
        assert files and all(open(f).readline().startswith(first) for f in files)
        assert all(sum(1 for line in open(f) if line.startswith(first)) == 1 for f in files)
    summary = spark.read.json(f"{out_root}/KIND=monthly-stats").collect()
    assert summary and all(r.monthly_history_rows > 0 for r in summary)
    daily_stats = spark.read.json(f"{out_root}/KIND=daily-stats")
    assert "monthly_history_rows" not in daily_stats.columns
    # the raw counts ignore the window: equal in both summaries of a station
    cols = ["ID", "TMIN_raw_count", "TMAX_raw_count", "PRCP_raw_count"]
    m = spark.read.json(f"{out_root}/KIND=monthly-stats").select(*cols)
    assert m.exceptAll(daily_stats.select(*cols)).count() == 0
    parts = sorted(glob.glob(f"{out_root}/matched_stations.geojson/part-*"))
    doc = json.loads("".join(open(p).read() for p in parts))
    assert doc["type"] == "FeatureCollection"
    ids = {f["properties"]["ID"] for f in doc["features"]}
    assert not any(i.startswith("USW") for i in ids)
    with_data = {r.ID for r in daily.select("ID").distinct().collect()}
    for f in doc["features"]:
        assert f["geometry"]["type"] == "Point" and len(f["geometry"]["coordinates"]) == 2
        assert f["properties"]["MISSING"] == (f["properties"]["ID"] not in with_data)


def test_wide_job(spark, tmp_path):
    w = tv.t_wide(spark, SF_SMALL)
    w.write.partitionBy("STATION").parquet(str(tmp_path / "w"))
    m = tv.t_wide_monthly(spark, SF_SMALL)
    m.write.partitionBy("STATION").parquet(str(tmp_path / "m"))
    jobs.wide_job(spark, str(tmp_path / "w"), str(tmp_path / "o"), wide_monthly_root=str(tmp_path / "m"))
    files = glob.glob(str(tmp_path / "o" / "KIND=daily" / "PFX=*" / "ID=*" / "part-*"))
    assert files and open(files[0]).readline().strip().startswith("DAY,TMIN_P10")
    assert len(files) == w.select("STATION").distinct().count()  # one file per station
    back = scan_output_csv(spark, str(tmp_path / "o" / "KIND=monthly"), "monthly")
    exp = wd.agg_wide_by_month(m, decimals=2)
    assert back.exceptAll(exp).count() == 0 and exp.exceptAll(back).count() == 0


def test_cli_station_run(spark, layout):
    from stationclim.__main__ import main

    out_root = str(layout["root"] / "one")
    ids = [r.ID for r in tv.t_obs(spark, SF_SMALL).select("ID").distinct().orderBy("ID").limit(2).collect()]
    assert main(["station", "--merged", layout["merged"], "--out", out_root, "--id", ids[0], "--id", ids[1]]) == 0
    got = scan_output_csv(spark, f"{out_root}/KIND=monthly", "monthly")
    exp = clim.monthly_output(tv.t_obs(spark, SF_SMALL)).where(F.col("ID").isin(*ids))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    only_daily = str(layout["root"] / "one-daily")
    assert main(["station", "--merged", layout["merged"], "--out", only_daily, "--id", ids[0], "--window", "daily"]) == 0
    assert sorted(d for d in os.listdir(only_daily) if d.startswith("KIND=")) == ["KIND=daily", "KIND=daily-stats"]


def test_cli_merge_stations_wide(spark, tmp_path):
    from stationclim.__main__ import main

    raw, merged, lines, out = (str(tmp_path / p) for p in ("raw", "merged", "st", "out"))
    tv.t_raw(spark, SF_SMALL).write.partitionBy("STATION", "ELEMENT").parquet(raw)
    tv.t_station_lines(spark, SF_SMALL).write.text(lines)
    assert main(["merge", "--raw", raw, "--merged", merged]) == 0
    assert main(["stations", "--merged", merged, "--stations", lines, "--out", out, "--prefixes", "CHM,JA"]) == 0
    ids = {r.ID for r in scan_output_csv(spark, f"{out}/KIND=monthly", "monthly").select("ID").distinct().collect()}
    assert ids and all(i.startswith(("CHM", "JA")) for i in ids)
    wide, wout = str(tmp_path / "wide"), str(tmp_path / "wout")
    tv.t_wide(spark, SF_SMALL).write.partitionBy("STATION").parquet(wide)
    assert main(["wide", "--wide", wide, "--out", wout]) == 0
    assert scan_output_csv(spark, f"{wout}/KIND=daily", "daily").count() > 0


def test_summaries_same_with_and_without_materialised_histogram(spark, layout):
    stations = tv.t_station_lines(spark, SF_SMALL)
    from stationclim.sources.stations import parse_station_lines

    st_df = parse_station_lines(stations)
    a = jobs.station_outputs(scan_obs_merged(spark, layout["merged"]), st_df)
    b = jobs.station_outputs(scan_obs_merged(spark, layout["merged"]), st_df, materialize="table")
    for x, y in ((a.daily_summary, b.daily_summary), (a.monthly_summary, b.monthly_summary)):
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0
    jobs.release(b)


def test_ignore_mode_is_per_station(spark, tmp_path):
    """A second run in ``ignore`` mode writes new stations and leaves the others as they were."""
    root = str(tmp_path / "out")
    schema = "KIND string, PFX string, ID string, _ORD bigint, value string"
    writers.write_lines(spark.createDataFrame([("daily", "CHM", "CHM1", 0, "old")], schema), root, mode="ignore")
    again = [("daily", "CHM", "CHM1", 0, "new"), ("monthly", "CHM", "CHM1", 0, "m"), ("daily", "00", "007", 0, "b")]
    writers.write_lines(spark.createDataFrame(again, schema), root, mode="ignore")
    got = spark.read.schema("value string, KIND string, PFX string, ID string").text(root).collect()
    assert {(r.KIND, r.ID, r.value) for r in got} == {("daily", "CHM1", "old"), ("monthly", "CHM1", "m"), ("daily", "007", "b")}


def test_released_histogram_leaves_no_files(spark, layout, monkeypatch):
    """Also after a write that fails."""
    scratch = os.path.join(spark.sparkContext.getCheckpointDir().replace("file:", ""), "stationclim-scratch")
    left = lambda: set(glob.glob(os.path.join(scratch, "day_histogram-*")))
    before = left()
    one = tv.t_obs(spark, SF_SMALL).select("ID").first().ID
    jobs.selected_stations_job(spark, layout["merged"], [one], str(layout["root"] / "released"))
    assert left() == before

    def fail(*a, **k):
        raise OSError("full")

    monkeypatch.setattr(writers, "write_lines", fail)
    with pytest.raises(OSError):
        jobs.selected_stations_job(spark, layout["merged"], [one], str(layout["root"] / "failed"))
    assert left() == before


def test_bucket_count_keeps_the_limit(spark):
    from stationclim.plans import sizing

    assert int(sizing.scale_conf(100 << 40)["spark.sql.shuffle.partitions"]) > 100_000
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        out = sizing.write_bucketed_table(spark.range(10).selectExpr("cast(id as string) ID"), "limit")
        assert out.count() == 10
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    spark.sql(f"DROP TABLE {out._stationclim_table}")
