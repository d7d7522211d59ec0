"""End-to-end batch jobs.

* ``merge_job``             raw hive layout -> merged, ID/DATE-sorted table per element
* ``all_stations_job``      every matched station: daily, monthly, history, summaries, GeoJSON
* ``selected_stations_job`` the same for a list of station IDs (pushed ID filter)
* ``wide_job``              legacy ordinal-day / month aggregation of wide files

The station jobs scan the observations once.  The day histogram, clustered by
(ID, MONTH), is by default written as a table bucketed by both under the shared
checkpoint folder or, with ``materialize="cache"``, persisted (memory, spilling
to disk; a lost block is recomputed from lineage); every output is derived from
it without shuffling it again.

Each run enters what it has finished in the output root's manifest
(``sinks/manifest.py``).  In ``ignore`` mode stations with all their outputs are
left out before the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import since
from ..operators import climatology as clim
from ..operators import stations as st
from ..operators import wide as wd
from ..schema import DEFAULT_CUTOFF, ELEMENTS, STATION_PREFIXES
from ..plans.sizing import write_bucketed_table
from ..session import drop_path, ensure_checkpoint_dir
from ..sinks import bundles, manifest, writers
from ..sources.observations import parse_obs_dates, scan_obs_merged, scan_obs_partitioned
from ..sources.stations import scan_stations_fixed_width
from ..sources.wide import scan_wide_station_file


def merge_job(spark: SparkSession, raw_root: str, merged_root: str, elements: Sequence[str] = ELEMENTS,
              mode: str = "overwrite", strict_dates: bool = True) -> None:
    raw = scan_obs_partitioned(spark, raw_root, elements)
    writers.write_merged_parquet(parse_obs_dates(raw, strict_dates), merged_root, mode)


@dataclass
class StationOutputs:
    daily: DataFrame
    monthly: DataFrame
    history: DataFrame
    daily_summary: DataFrame
    monthly_summary: DataFrame
    stations: DataFrame  # matched stations with MISSING
    histogram: DataFrame  # day histogram, clustered by (ID, MONTH), all outputs derive from
    month_raw: DataFrame  # per (ID, YEAR, MONTH) integer statistics: history and monthly in one pass


def station_outputs(obs: DataFrame, stations: DataFrame, cutoff=DEFAULT_CUTOFF,
                    prefixes: Sequence[str] = STATION_PREFIXES, materialize: str | None = None,
                    persist: bool = False) -> StationOutputs:
    """All outputs of all matched stations from one scan of ``obs``.

    Every output hangs off the same day histogram, clustered by (ID, MONTH), which
    can be materialised once so all outputs share one scan and two shuffles:

    * ``"cache"`` (or ``persist=True``): cached in memory, spilling to disk; a
      lost block is recomputed from its lineage;
    * ``"table"``: written as a table bucketed by (ID, MONTH) under the shared
      checkpoint folder -- lineage cut, survives executor loss without
      recomputation, and the bucketed scan keeps the partitioning.

    Without materialisation each output recomputes the histogram.
    """
    if persist and materialize is None:
        materialize = "cache"
    matched = st.filter_station_prefix(stations, prefixes)
    obs_m = st.filter_station(st.filter_station_prefix(obs, prefixes), matched)
    day_hist = clim.day_histogram(obs_m, cutoff)
    if materialize == "table":
        ensure_checkpoint_dir(obs.sparkSession)
        day_hist = write_bucketed_table(day_hist, "day_histogram", clim.CLUSTER)
    elif materialize == "cache":
        day_hist = day_hist.persist(StorageLevel.MEMORY_AND_DISK)
        # Materialise now: an unfilled cache reports unknown partitioning, and
        # plans built on it would shuffle the histogram again.
        day_hist.count()
    elif materialize is not None:
        raise ValueError(f"materialize must be None, 'cache' or 'table', not {materialize!r}")

    daily = clim.assemble_daily(clim.year_day_summary(day_hist), day_hist)
    ym = clim.year_month_summary(clim.month_histogram_from_days(day_hist))
    monthly = clim.assemble_monthly(ym)
    history = clim.assemble_history(ym)
    month_raw = clim.month_level_raw(ym)

    # A summary exists only where the corresponding output has rows.  With the
    # histogram materialised the counts come from it (only sums are shuffled);
    # otherwise they come from partial aggregates of the observations instead of
    # rebuilding the value histogram just to count rows.
    if materialize is not None:
        nonnull = F.col("DATA_VALUE").isNotNull()
        counts = day_hist.groupBy("ID").agg(*[
            F.coalesce(F.sum(F.when(nonnull & (F.col("ELEMENT") == e), F.col("C"))), F.lit(0).cast("long"))
            .alias(f"{e}_raw_count") for e in ELEMENTS
        ])
        hist_rows = clim.history_rows_from_histogram(day_hist)
    else:
        counts = clim.summary_counts(obs_m, cutoff)
        hist_rows = clim.history_rows_from_obs(obs_m, cutoff)
    daily_summary = writers.summary_frame(counts)
    monthly_summary = counts.join(hist_rows, "ID").select(
        "ID", *[f"{e}_raw_count" for e in ELEMENTS], "monthly_history_rows"
    )
    flagged = st.flag_missing(matched, daily, monthly)
    return StationOutputs(daily, monthly, history, daily_summary, monthly_summary, flagged, day_hist, month_raw)


GEOJSON = "matched_stations.geojson"
KINDS = {"daily": ("daily", "daily-stats"), "monthly": ("monthly", "monthly-history", "monthly-stats")}  # by window


def unfinished(stations: DataFrame, done: DataFrame | None, windows: Sequence[str] = ("daily", "monthly")) -> DataFrame:
    """Stations that lack an output of one of ``windows`` in the manifest ``done``."""
    if done is None:
        return stations
    return stations.join(manifest.finished(done, *windows), "ID", "left_anti")


def run_stations(obs: DataFrame, stations: DataFrame, root: str, cutoff=DEFAULT_CUTOFF,
                 prefixes: Sequence[str] = STATION_PREFIXES, mode: str = "overwrite", materialize: str = "table",
                 windows: Sequence[str] = ("daily", "monthly"), layout: str = "station") -> StationOutputs:
    """Write the outputs of the matched ``stations`` under ``root`` and enter them in its manifest.

    ``mode="ignore"`` leaves finished outputs as they are.  Stations that have
    all of theirs are taken off the list by an anti join with the manifest, below
    the semi join that selects the observations, so they cost no scan of their row
    groups beyond the ID filter and no aggregation.  A station without rows for
    an output is tried again by the next run.

    The returned ``stations`` carry MISSING as the manifest then has it: a
    station that an earlier run wrote is not MISSING though this run has no rows
    for it.
    """
    spark = obs.sparkSession
    root, run = root.rstrip("/"), manifest.new_run()
    done = manifest.completed(spark, root) if mode == "ignore" else None
    todo = unfinished(st.filter_station_prefix(stations, prefixes), done, windows)
    out = station_outputs(obs, todo, cutoff, prefixes, materialize=materialize)
    try:
        write_station_outputs(out, root, mode, windows, done, layout, run)
        # A summary has a row exactly where the window's outputs have rows.
        keys = None
        for window, summary in (("daily", out.daily_summary), ("monthly", out.monthly_summary)):
            if window in windows:
                kinds = F.explode(F.array(*[F.lit(k) for k in KINDS[window]]))
                each = st.with_path_prefix(summary.select("ID")).select(kinds.alias("KIND"), "PFX", "ID")
                keys = each if keys is None else keys.unionByName(each)
        if done is not None:
            keys = keys.join(done.select(*manifest.KEYS), list(manifest.KEYS), "left_anti")
        manifest.commit(keys, root, run)
    finally:
        release(out)
    out.stations = flag_from_manifest(st.filter_station_prefix(stations, prefixes), root)
    return out


def flag_from_manifest(stations: DataFrame, root: str) -> DataFrame:
    """``stations`` with MISSING: the root's manifest lacks the daily or the monthly output."""
    done = manifest.completed(stations.sparkSession, root)
    if done is None:
        return stations.withColumn("MISSING", F.lit(True))
    return st.flag_missing(stations, done.where("KIND = 'daily'"), done.where("KIND = 'monthly'"))


def all_stations_job(spark: SparkSession, merged_root: str, stations_path: str, out_root: str,
                     cutoff=DEFAULT_CUTOFF, prefixes: Sequence[str] = STATION_PREFIXES,
                     mode: str = "overwrite", materialize: str = "table", layout: str = "station") -> StationOutputs:
    """Write daily / monthly / history CSVs, summaries and the GeoJSON layer.

    Layout: ``out_root/KIND=<daily|monthly|monthly-history|daily-stats|
    monthly-stats>/PFX=<prefix>/ID=<station>/part-*`` (or bundles, see
    ``sinks/bundles.py``) plus ``out_root/matched_stations.geojson/``.  All
    per-station files are written by one job from the materialised histogram.
    The GeoJSON covers the whole list and is rewritten in every mode.
    """
    root = out_root.rstrip("/")
    out = run_stations(scan_obs_merged(spark, merged_root), scan_stations_fixed_width(spark, stations_path), root,
                       cutoff, prefixes, mode, materialize, layout=layout)
    writers.write_geojson(st.geojson_features(out.stations), f"{root}/{GEOJSON}")
    return out


def release(out: StationOutputs) -> None:
    """Drop the materialised histogram: unpersist a cache, forget a bucketed table and delete its files."""
    h = out.histogram
    if h.storageLevel.useMemory or h.storageLevel.useDisk:
        h.unpersist()
    name = getattr(h, "_stationclim_table", None)
    if name:
        h.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(h.sparkSession, h._stationclim_path)


WINDOWS = ("daily", "monthly")


def write_station_outputs(out: StationOutputs, root: str, mode: str = "overwrite",
                          windows: Sequence[str] = WINDOWS, done: DataFrame | None = None,
                          layout: str = "station", run: str | None = None) -> None:
    """Outputs of ``out`` for the given windows in one partitioned text write.

    ``daily`` writes the daily climatology and its summary; ``monthly`` the
    monthly climatology, the history and their summary.  Monthly climatology
    and history lines come from one pass over the month-level statistics
    (``writers.month_level_lines``).  ``done`` names what ``mode="ignore"`` leaves
    alone.  ``layout`` is ``"station"`` (one directory per kind and station) or
    ``"bundle"`` (bounded files of many stations, ``sinks/bundles.py``).
    """
    unknown = set(windows) - set(WINDOWS)
    if unknown or not windows:
        raise ValueError(f"windows must be a non-empty subset of {WINDOWS}, got {list(windows)}")
    parts = []
    if "daily" in windows:
        parts += [writers.csv_lines(out.daily, "daily"), writers.json_lines(out.daily_summary, "daily-stats")]
    if "monthly" in windows:
        parts += [writers.month_level_lines(out.month_raw, "monthly-history", "monthly"),
                  writers.json_lines(out.monthly_summary, "monthly-stats")]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    if layout == "bundle":
        bundles.write_bundles(lines, root.rstrip("/"), run or manifest.new_run(), done if mode == "ignore" else None)
    elif layout == "station":
        writers.write_lines(lines, root.rstrip("/"), mode, done=done)
    else:
        raise ValueError(f"layout must be 'station' or 'bundle', not {layout!r}")


def selected_stations_job(spark: SparkSession, merged_root: str, station_ids: Sequence[str], out_root: str,
                          cutoff=DEFAULT_CUTOFF, mode: str = "overwrite", materialize: str = "table",
                          windows: Sequence[str] = WINDOWS) -> StationOutputs:
    """Outputs for the given stations only (the per-station runs of the original scripts).

    The ID list becomes a pushed ``In`` / ``EqualTo`` parquet filter, so only the
    row groups of those stations are read from the ID-sorted merged table.
    """
    obs = scan_obs_merged(spark, merged_root, stations=list(dict.fromkeys(station_ids)))
    ids = spark.createDataFrame([(i,) for i in dict.fromkeys(station_ids)], "ID string")
    return run_stations(obs, ids, out_root, cutoff, ("",), mode, materialize, windows)


def wide_job(spark: SparkSession, wide_root: str, out_root: str, cutoff=DEFAULT_CUTOFF,
             mode: str = "overwrite", wide_monthly_root: str | None = None) -> None:
    """``out_root/KIND=<daily|monthly>/PFX=/ID=/part-*``: one CSV per station and kind, one job.

    The monthly kind comes from the monthly files (one row per station and
    month) under ``wide_monthly_root``; without that root only the daily kind is written.
    """
    root, run = out_root.rstrip("/"), manifest.new_run()
    done = manifest.completed(spark, root) if mode == "ignore" else None
    lines = keys = None
    for kind, columns, source, agg in (("daily", "wide_daily", wide_root, wd.agg_wide_by_ordinal_day),
                                       ("monthly", "wide_monthly", wide_monthly_root, wd.agg_wide_by_month)):
        if source is None:
            continue
        wide = scan_wide_station_file(spark, source)
        if done is not None:
            finished = manifest.finished(done, kind).withColumnRenamed("ID", "STATION")
            wide = wide.join(finished, "STATION", "left_anti")
        each = writers.csv_lines(agg(wide, cutoff, 2), columns, kind)
        rows = wide if cutoff is None else wide.where(since("DATE", cutoff))
        ids = st.with_path_prefix(rows.select(F.col("STATION").alias("ID")).distinct()).select(F.lit(kind).alias("KIND"), "PFX", "ID")
        lines = each if lines is None else lines.unionByName(each)
        keys = ids if keys is None else keys.unionByName(ids)
    writers.write_lines(lines, root, mode, done=done)
    manifest.commit(keys, root, run)
