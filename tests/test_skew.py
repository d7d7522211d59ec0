"""A station holding a third of all rows, with heavy duplication per day."""

from __future__ import annotations

import random

from conftest import obs_frame
from stationclim.operators import climatology as clim
from test_semantics import nearest


def test_hot_station_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for s in ("S1", "S2", "S3", "S4", "S5", "S6"):
        for d in range(1, 11):
            rows.append((s, "TMIN", f"1980-01-{d:02d}", rnd.randint(-50, 50)))
    n_other = len(rows)
    hot = [("HOT", "TMIN", f"1980-01-{rnd.randint(1, 3):02d}", rnd.choice([None] + list(range(-30, 31))))
           for _ in range(n_other // 2)]
    rows += hot
    o = obs_frame(spark, rows).repartition(8)
    yd = {(r.ID, r.DAY_OF_MONTH): r for r in clim.year_day_summary(clim.day_histogram(o)).collect()}
    for day in (1, 2, 3):
        vals = [v for i, _, d, v in hot if d == f"1980-01-{day:02d}"]
        if not vals:
            continue
        r = yd[("HOT", day)]
        nn = [v for v in vals if v is not None]
        assert (r.P10, r.P90, r.COUNT, r.SUM) == (nearest(vals, 0.1), nearest(vals, 0.9), len(nn), sum(nn))
    # the histogram of the hot station is bounded by distinct values, not rows
    h = clim.day_histogram(o).where("ID = 'HOT'").count()
    assert h <= 3 * 62


def test_a_hot_station_is_the_work_of_twelve_tasks(spark):
    rows = [("HOT", "TMIN", f"1980-{m:02d}-{d:02d}", (m * d) % 7) for m in range(1, 13) for d in (1, 15, 28)]
    o = obs_frame(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "997")  # so many that two months hardly share one
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for h in (clim.day_histogram(o), clim.month_histogram(o)):
            assert h.selectExpr("spark_partition_id() AS p").distinct().count() == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = [(r.MONTH, r.DAY_OF_MONTH, r.DAY) for r in clim.daily_output(o).orderBy("DAY").collect()]
    assert got == [(m, d, 3 * (m - 1) + k) for m in range(1, 13) for k, d in enumerate((1, 15, 28), 1)]
