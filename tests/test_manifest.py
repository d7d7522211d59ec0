"""Runs into one root: the manifest, ``ignore`` mode, MISSING across runs, GeoJSON, bundles."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, obs_frame
from stationclim.operators import climatology as clim
from stationclim.operators import stations as st
from stationclim.operators.ordering import release, with_position
from stationclim.plans import jobs
from stationclim.sinks import bundles, manifest, writers
from stationclim.sources import testviews as tv
from stationclim.sources.outputs import scan_output_csv
from stationclim.sources.stations import parse_station_lines


def observations(spark, ids, value=10):
    return obs_frame(spark, [(i, e, f"19{y}-0{m}-0{d}", value + m + d) for i in ids for e in ("TMIN", "TMAX", "PRCP")
                             for y in (71, 72) for m in (1, 3) for d in (1, 2)])


def station_list(spark, ids):
    return spark.createDataFrame([(i, 1.0, 2.0, 3.0, "", "n", "", "", "") for i in ids], (
        "ID string, LATITUDE double, LONGITUDE double, ELEVATION double, STATE string, NAME string, GSN_FLAG string, "
        "HCN_CRN_FLAG string, WMO_ID string"))


def files(root):
    return {f: open(f).read() for f in glob.glob(f"{root}/KIND=*/PFX=*/ID=*/part-*")}


def document(root):
    return json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{root}/{jobs.GEOJSON}/part-*"))))


@pytest.fixture()
def inputs(spark, tmp_path):
    """merge(ids, value) and stations(ids) write inputs of the job and return their paths."""

    def merge(ids, value=10):
        path = str(tmp_path / f"merged-{len(ids)}-{value}")
        writers.write_merged_parquet(observations(spark, ids, value), path)
        return path

    def lines(ids):
        path = str(tmp_path / f"stations-{len(ids)}")
        spark.createDataFrame([(f"{i:<11} {1:>8} {2:>9} {3:>6}    name",) for i in ids], "value string").write.mode("overwrite").text(path)
        return path

    return merge, lines


def test_second_run_writes_only_new_stations(spark, inputs, tmp_path):
    merge, lines = inputs
    root = str(tmp_path / "out")
    first, grown = ["CHM00000001", "JA000000002"], ["CHM00000001", "JA000000002", "JA000000002", "KSM00000003", "KSM00000004"]
    jobs.all_stations_job(spark, merge(first), lines(first), root)
    before, doc = files(root), document(root)
    assert len(before) == 10 and [f["properties"]["MISSING"] for f in doc["features"]] == [False, False]
    out = jobs.all_stations_job(spark, merge(["KSM00000003", "JA000000002", "CHM00000001"], 90), lines(grown), root, mode="ignore")
    after = files(root)
    assert {f: after[f] for f in before} == before              # what was finished is untouched
    assert {f.split("ID=")[1].split("/")[0] for f in set(after) - set(before)} == {"KSM00000003"} and len(after) == 15
    # The GeoJSON covers the grown list with its repeated ID, and is valid.
    doc = document(root)
    assert [(f["properties"]["ID"], f["properties"]["MISSING"]) for f in doc["features"]] == [
        ("CHM00000001", False), ("JA000000002", False), ("JA000000002", False), ("KSM00000003", False), ("KSM00000004", True)]
    assert out.histogram.sparkSession is spark and out.stations.count() == 5
    # A third run finds nothing to do but the station without rows.
    jobs.all_stations_job(spark, merge(grown[:3], 70), lines(grown), root, mode="ignore")
    assert files(root) == after and len(document(root)["features"]) == 5


def test_an_earlier_runs_station_is_not_missing(spark, tmp_path):
    root = str(tmp_path / "out")
    a, b = ["CHM00000001"], ["CHM00000001", "CHM00000002"]
    jobs.run_stations(observations(spark, a), station_list(spark, a), root)
    for mode in ("ignore", "overwrite"):
        out = jobs.run_stations(observations(spark, ["CHM00000002"]), station_list(spark, b), root, mode=mode)
        assert {(r.ID, r.MISSING) for r in out.stations.collect()} == {("CHM00000001", False), ("CHM00000002", False)}
    # Only null values: a daily output, no monthly one.
    nulls = obs_frame(spark, [("CHM00000009", "TMIN", "1980-01-01", None)])
    out = jobs.run_stations(nulls, station_list(spark, ["CHM00000009"]), root, mode="ignore")
    assert [r.MISSING for r in out.stations.collect()] == [True]
    kinds = {r.KIND for r in manifest.completed(spark, root).where("ID = 'CHM00000009'").collect()}
    assert kinds == {"daily", "daily-stats"}
    # It gets values: the missing kinds are added, the daily ones stay as they are.
    kept = {f: t for f, t in files(root).items() if "CHM00000009" in f}
    out = jobs.run_stations(observations(spark, ["CHM00000009"]), station_list(spark, ["CHM00000009"]), root, mode="ignore")
    now = {f: t for f, t in files(root).items() if "CHM00000009" in f}
    assert [r.MISSING for r in out.stations.collect()] == [False] and len(now) == 5 and {f: now[f] for f in kept} == kept


def test_an_unfinished_run_is_written_again(spark, tmp_path, monkeypatch):
    """Files without an entry in the manifest are replaced, not added to."""
    root = str(tmp_path / "out")
    ids = ["CHM00000001", "CHM00000002"]
    jobs.run_stations(observations(spark, ids[:1]), station_list(spark, ids[:1]), root)

    def broken(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", broken)
        with pytest.raises(OSError):
            jobs.run_stations(observations(spark, ids, 50), station_list(spark, ids), root, mode="ignore")
    assert len(files(root)) == 10
    jobs.run_stations(observations(spark, ids, 70), station_list(spark, ids), root, mode="ignore")
    assert len(files(root)) == 10
    got = {r.ID: r.TMIN_MIN for r in scan_output_csv(spark, f"{root}/KIND=monthly", "monthly").where("MONTH = 1").collect()}
    assert got == {"CHM00000001": 1.2, "CHM00000002": 7.2}


def test_a_root_without_manifest_is_adopted(spark, tmp_path):
    root = str(tmp_path / "out")
    jobs.run_stations(observations(spark, ["CHM00000001"]), station_list(spark, ["CHM00000001"]), root)
    bare = str(tmp_path / "bare")
    os.makedirs(bare)
    for d in glob.glob(f"{root}/KIND=*"):
        os.symlink(d, os.path.join(bare, os.path.basename(d)))
    assert manifest.completed(spark, str(tmp_path / "nothing")) is None
    assert {(r.KIND, r.PFX, r.ID) for r in manifest.completed(spark, bare).collect()} == {
        (k, "CHM", "CHM00000001") for ks in jobs.KINDS.values() for k in ks}


def test_ignore_mode_of_the_wide_job(spark, tmp_path):
    w = tv.t_wide(spark, SF_SMALL)
    one = w.orderBy("STATION").first().STATION
    w.where(F.col("STATION") == one).write.partitionBy("STATION").parquet(str(tmp_path / "one"))
    w.write.partitionBy("STATION").parquet(str(tmp_path / "all"))
    root = str(tmp_path / "out")
    jobs.wide_job(spark, str(tmp_path / "one"), root)
    before = files(root)
    jobs.wide_job(spark, str(tmp_path / "all"), root, mode="ignore")
    after = files(root)
    assert len(before) == 1 and len(after) == w.select("STATION").distinct().count() and before.items() <= after.items()


@pytest.mark.parametrize("ids", [[], ["A"], ["B", "A", "B", "B"], [f"S{k % 40:03d}" for k in range(400)]])
def test_geojson_is_valid_for_any_list(spark, tmp_path, ids):
    feats = spark.createDataFrame([(i, json.dumps({"type": "Feature", "n": k})) for k, i in enumerate(ids)], "ID string, FEATURE string")
    for part in (feats.repartition(7), feats):  # rewritten
        writers.write_geojson(part, str(tmp_path / "g"))
        doc = json.loads("".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "g" / "part-*")))))
        assert [ids[f["n"]] for f in doc["features"]] == sorted(ids)


def test_geojson_evaluates_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    feats = spark.createDataFrame([(f"S{k}", "{}") for k in range(50)], "ID string, FEATURE string").mapInArrow(count, "ID string, FEATURE string")
    scratch = glob.glob(os.path.join(spark.sparkContext.getCheckpointDir().replace("file:", ""), "stationclim-scratch", "position-*"))
    writers.write_geojson(feats, str(tmp_path / "g"))
    assert seen.value <= 100  # once, and once more at most for the sample that the range partitioning takes
    assert glob.glob(os.path.join(spark.sparkContext.getCheckpointDir().replace("file:", ""), "stationclim-scratch", "position-*")) == scratch


def test_positions(spark):
    rows = [(k % 7 if k % 10 else None, str(k % 3)) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(6)
    placed = with_position(df, ["a", "b"])
    got = [(r.a, r.b, r.POSITION) for r in placed.orderBy("POSITION").collect()]
    release(placed)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(*r, k) for k, r in enumerate(want)]
    assert with_position(df.limit(0), ["a"]).count() == 0


def test_bundles(spark, tmp_path):
    root = str(tmp_path / "b")
    ids = [f"CHM000000{k:02d}" for k in range(12)]
    o = observations(spark, ids)
    jobs.run_stations(o, station_list(spark, ids), root, layout="bundle")
    assert len(glob.glob(f"{root}/KIND=*/PFX=*")) == 5                      # not five per station
    text = [c for c in clim.daily_output(o).columns]
    got = bundles.scan_bundle_csv(spark, root, "daily").drop("PFX")
    want = writers.csv_text_columns(clim.daily_output(o), "daily").select(text)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    index = bundles.bundle_index(spark, root)
    assert index.where("KIND = 'daily'").groupBy("ID").agg(F.sum("LINES").alias("n")).where("n = 4").count() == 12
    # Ignore: only the new station; overwrite: the later run supersedes the earlier one, station by station.
    more = [*ids, "CHM00000099"]
    jobs.run_stations(observations(spark, more, 60), station_list(spark, more), root, mode="ignore", layout="bundle")
    jobs.run_stations(observations(spark, ids[:1], 80), station_list(spark, ids[:1]), root, layout="bundle")
    low = {r.ID: r.TMIN_MIN for r in bundles.scan_bundle_csv(spark, root, "monthly").where("MONTH = '1'").collect()}
    assert low == {**{i: "1.20" for i in ids}, "CHM00000099": "6.20", ids[0]: "8.20"}
    assert bundles.scan_bundle_lines(spark, root).where("KIND = 'monthly-stats'").count() == 13
    lines = writers.csv_lines(clim.daily_output(o), "daily")
    small = str(tmp_path / "small")
    bundles.write_bundles(lines, small, "r1", max_lines=5)
    sizes = [sum(1 for _ in open(f)) for f in glob.glob(f"{small}/KIND=*/PFX=*/RUN=*/part-*")]
    assert max(sizes) <= 5 and sum(sizes) == 48
    with pytest.raises(ValueError):
        jobs.run_stations(o, station_list(spark, ids), root, layout="zip")


def test_lookup_takes_one_id_a_list_or_a_frame(spark):
    lines = parse_station_lines(tv.t_station_lines(spark, SF_SMALL))
    ids = [r.ID for r in lines.orderBy("ID").limit(3).collect()]
    for given, n in ((ids[0], 1), (ids, 3), (lines.where(F.col("ID").isin(ids)).select("ID"), 3), ("none", 0), ([], 0)):
        assert st.lookup_station(lines, given).count() == n
