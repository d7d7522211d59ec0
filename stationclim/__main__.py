"""Command line: ``python -m stationclim <command> ...`` (Spark settings from spark-defaults / PYSPARK_SUBMIT_ARGS).

Commands
  merge     raw STATION=/ELEMENT= layout -> merged table
  stations  every station matching the prefixes: daily, monthly, history, summaries, GeoJSON
  station   the same outputs for the given station IDs only (scan filtered by ID)
  wide      ordinal-day / month aggregation of wide per-station files
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from .schema import DEFAULT_CUTOFF, STATION_PREFIXES


def _args(argv):
    p = argparse.ArgumentParser(prog="stationclim")
    sub = p.add_subparsers(dest="cmd", required=True)

    m = sub.add_parser("merge")
    m.add_argument("--raw", required=True)
    m.add_argument("--merged", required=True)

    for name in ("stations", "station"):
        s = sub.add_parser(name)
        s.add_argument("--merged", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--cutoff", default=DEFAULT_CUTOFF.isoformat())
        s.add_argument("--mode", default="overwrite", choices=["overwrite", "ignore"])
        if name == "stations":
            s.add_argument("--stations", required=True, help="fixed-width station list")
            s.add_argument("--prefixes", default=",".join(STATION_PREFIXES))
            s.add_argument("--layout", default="station", choices=["station", "bundle"])
        else:
            s.add_argument("--id", action="append", required=True, help="station ID (repeatable)")
            s.add_argument("--window", default="both", choices=["daily", "monthly", "both"])

    w = sub.add_parser("wide")
    w.add_argument("--wide", required=True)
    w.add_argument("--wide-monthly", help="root of the monthly files; without it only the daily kind is written")
    w.add_argument("--out", required=True)
    w.add_argument("--cutoff", default=DEFAULT_CUTOFF.isoformat())
    w.add_argument("--mode", default="overwrite", choices=["overwrite", "ignore"])
    return p.parse_args(argv)


def main(argv=None) -> int:
    a = _args(sys.argv[1:] if argv is None else argv)
    from .plans import jobs
    from .session import get_session

    spark = get_session()
    if a.cmd == "merge":
        jobs.merge_job(spark, a.raw, a.merged)
    elif a.cmd == "stations":
        jobs.all_stations_job(spark, a.merged, a.stations, a.out, dt.date.fromisoformat(a.cutoff),
                              tuple(x for x in a.prefixes.split(",") if x), a.mode, layout=a.layout)
    elif a.cmd == "station":
        windows = jobs.WINDOWS if a.window == "both" else (a.window,)
        jobs.selected_stations_job(spark, a.merged, a.id, a.out, dt.date.fromisoformat(a.cutoff), a.mode,
                                   windows=windows)
    elif a.cmd == "wide":
        jobs.wide_job(spark, a.wide, a.out, dt.date.fromisoformat(a.cutoff), a.mode, a.wide_monthly)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
