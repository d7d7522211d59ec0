"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` (default 8) against ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Each query is run once to warm up (JIT, file listing) and then timed;
results are fully computed through the ``noop`` sink, so no rows are
collected to the driver.  ``merge_job`` and ``all_stations_job`` time the
production jobs end to end (raw layout -> merged table -> all outputs);
``assemble_daily_hot_station`` reruns the daily query with a third of all
observations relabelled to one station (skew check).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stationclim.plans import jobs, registry  # noqa: E402
from stationclim.session import get_session, scratch_path  # noqa: E402
from stationclim.sources import testviews as tv  # noqa: E402

HEADLINE = [
    "assemble_daily",
    "assemble_monthly",
    "assemble_history",
    "assemble_all_stations",
    "flag_missing",
    "agg_wide_by_ordinal_day",
    "chart_history_series",
]


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                        extra={"spark.driver.memory": "16g"})

    # One untimed pass over a representative query warms the JVM (class loading, codegen).
    registry.QUERIES["assemble_monthly"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in HEADLINE:
        q = registry.QUERIES[name]
        run = lambda: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        times[name] = round(timed(run), 3)

    # Skew: the same daily query with a third of all observations moved to one station.
    from pyspark.sql import functions as F

    from stationclim.operators import climatology as clim

    def hot():
        o = tv.t_obs(spark, sf_dir)
        o = o.withColumn("ID", F.when(F.abs(F.hash("ID", "DATE", "DATA_VALUE")) % 3 == 0, F.lit("HOT00000000"))
                         .otherwise(F.col("ID")))
        clim.daily_output(o).write.format("noop").mode("overwrite").save()

    hot()
    times["assemble_daily_hot_station"] = round(timed(hot), 3)

    # Production jobs: raw hive layout -> merged table -> every output.
    raw = scratch_path(spark, "bench-raw")
    tv.t_raw(spark, sf_dir).write.partitionBy("STATION", "ELEMENT").parquet(raw)
    station_txt = scratch_path(spark, "bench-stations")
    tv.t_station_lines(spark, sf_dir).write.text(station_txt)
    merged = scratch_path(spark, "bench-merged")
    times["merge_job"] = round(timed(lambda: jobs.merge_job(spark, raw, merged)), 3)
    out = scratch_path(spark, "bench-out")
    times["all_stations_job"] = round(
        timed(lambda: jobs.all_stations_job(spark, merged, station_txt, out)), 3
    )

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
