"""Print ``explain("formatted")`` of the headline plans and a one-line summary each.

Usage: python scripts/explain_plans.py [sf_dir] [--full]
The production-shaped plans read the merged table (as the all-stations job does).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stationclim.operators import climatology as clim  # noqa: E402
from stationclim.operators import stations as st  # noqa: E402
from stationclim.operators import wide as wd  # noqa: E402
from stationclim.plans import inspect as pi  # noqa: E402
from stationclim.plans import jobs  # noqa: E402
from stationclim.session import get_session, scratch_path  # noqa: E402
from stationclim.sinks import writers  # noqa: E402
from stationclim.sources import testviews as tv  # noqa: E402
from stationclim.sources.observations import scan_obs_merged  # noqa: E402
from stationclim.sources.stations import scan_stations_fixed_width  # noqa: E402
from stationclim.sources.wide import scan_wide_station_file  # noqa: E402


def summary(df) -> str:
    plan = pi.physical_plan(df)
    scans = pi.scan_nodes(df)
    parts = [
        f"shuffles={pi.count_exchanges(df)}",
        f"broadcasts={plan.count('BroadcastExchange')}",
        f"object_agg={pi.uses_object_aggregate(df)}",
        f"python_udf={'BatchEvalPython' in plan or 'ArrowEvalPython' in plan}",
    ]
    for s in scans:
        parts.append(f"scan[pushed={s['PushedFilters'][:120]} partition={s['PartitionFilters'][:80]} schema={s['ReadSchema'][:90]}]")
    return " ".join(parts)


def main() -> None:
    sf_dir = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    full = "--full" in sys.argv
    spark = get_session("local[8]", 8)
    raw = scratch_path(spark, "explain-raw")
    tv.t_raw(spark, sf_dir).write.partitionBy("STATION", "ELEMENT").parquet(raw)
    merged = scratch_path(spark, "explain-merged")
    jobs.merge_job(spark, raw, merged)
    lines = scratch_path(spark, "explain-stations")
    tv.t_station_lines(spark, sf_dir).write.text(lines)
    wide = scratch_path(spark, "explain-wide")
    tv.t_wide(spark, sf_dir).write.partitionBy("STATION").parquet(wide)

    obs = scan_obs_merged(spark, merged)
    stations = scan_stations_fixed_width(spark, lines)
    out = jobs.station_outputs(obs, stations, persist=True)
    all_lines = (
        writers.csv_lines(out.daily, "daily")
        .unionByName(writers.csv_lines(out.monthly, "monthly"))
        .unionByName(writers.csv_lines(out.history, "history", "monthly-history"))
        .unionByName(writers.json_lines(out.daily_summary, "daily-stats"))
        .unionByName(writers.json_lines(out.monthly_summary, "monthly-stats"))
    )
    plans = {
        "daily_output": clim.daily_output(obs),
        "monthly_output": clim.monthly_output(obs),
        "history_output": clim.history_output(obs),
        "one_station_daily": clim.daily_output(scan_obs_merged(spark, merged, stations=["CHM00000000"])),
        "raw_counts": clim.raw_counts(obs),
        "all_station_lines": all_lines,
        "flag_missing": st.flag_missing(st.filter_station_prefix(stations), out.daily_summary, out.monthly_summary),
        "wide_by_ordinal_day": wd.agg_wide_by_ordinal_day(scan_wide_station_file(spark, wide), decimals=2),
    }
    for name, df in plans.items():
        print(f"## {name}: {summary(df)}")
        if full:
            df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
