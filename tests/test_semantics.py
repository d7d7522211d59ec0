
from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from conftest import obs_frame
from stationclim.functions import exprs as X
from stationclim.operators import climatology as clim
from stationclim.operators import stations as st
from stationclim.operators import wide as wd
from stationclim.operators.summarize import summarize
from stationclim.sources.stations import parse_station_lines


def nearest(values, q):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    idx = math.floor((len(v) - 1) * q + 0.5)  # half away from zero for positives
    return v[idx]


def test_t1_nearest_rank_halves(spark):
    # n = 6, q = 0.1 -> (n-1)q = 0.5 rounds up to index 1; q = 0.9 -> 4.5 -> index 5
    df = spark.createDataFrame([("a", v) for v in (60, 10, 30, 20, 50, 40)], "K string, V long")
    r = summarize(df, ["K"], "V").collect()[0]
    assert (r.P10, r.P90, r.MIN, r.MAX, r.SUM, r.COUNT) == (20, 60, 10, 60, 210, 6)


def test_t1_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(60):
        n = rnd.randint(1, 40)
        for _ in range(n):
            rows.append((f"g{g}", rnd.choice([None] + list(range(-20, 20)))))
    df = spark.createDataFrame(rows, "K string, V long")
    got = {r.K: (r.P10, r.P90, r.MIN, r.MAX) for r in summarize(df, ["K"], "V").collect()}
    for g in {k for k, _ in rows}:
        vals = [v for k, v in rows if k == g]
        nn = [v for v in vals if v is not None]
        exp = (nearest(vals, 0.1), nearest(vals, 0.9), min(nn) if nn else None, max(nn) if nn else None)
        assert got[g] == exp, g


def test_t2_daily_keeps_all_null_day_with_zero_sum(spark):
    o = obs_frame(spark, [
        ("S1", "PRCP", "1980-01-01", None), ("S1", "PRCP", "1980-01-01", None),
        ("S1", "PRCP", "1980-01-02", 5),
    ])
    yd = clim.year_day_summary(clim.day_histogram(o)).orderBy("DAY_OF_MONTH").collect()
    assert [(r.DAY_OF_MONTH, r.SUM, r.MIN, r.P10) for r in yd] == [(1, 0, None, None), (2, 5, 5, 5)]
    daily = clim.daily_output(o).orderBy("DAY").collect()
    assert [(r.DAY, r.PRCP_SUM) for r in daily] == [(1, 0.0), (2, 5.0)]


def test_t3_monthly_counts_non_null(spark):
    o = obs_frame(spark, [
        ("S1", "TMIN", "1980-01-01", None), ("S1", "TMIN", "1980-01-02", 10), ("S1", "TMIN", "1980-01-03", 20),
    ])
    h = clim.history_output(o).collect()
    assert len(h) == 1 and h[0].TMIN_ENTRY_COUNT == 2


def test_t4_mean_of_years_min_of_mins(spark):
    o = obs_frame(spark, [
        ("S1", "TMIN", "1980-01-05", 10), ("S1", "TMIN", "1981-01-05", 30), ("S1", "TMIN", "1982-01-05", -40),
        ("S1", "TMAX", "1980-01-05", 100), ("S1", "TMAX", "1981-01-05", 300),
        ("S1", "PRCP", "1980-01-05", 4), ("S1", "PRCP", "1981-01-05", 8),
    ])
    r = clim.monthly_output(o).collect()[0]
    assert r.TMIN_P10 == 0.0  # (1 + 3 - 4) / 3 degrees
    assert r.TMIN_MIN == -4.0 and r.TMAX_MAX == 30.0 and r.TMAX_P90 == 20.0
    assert r.PRCP_SUM == 6.0  # precipitation is not scaled


def test_t5_round_half_even(spark):
    df = spark.createDataFrame([(1.015,), (0.125,), (0.375,), (2.5,), (-0.125,)], "x double")
    got = [r.y for r in df.select(X.round2("x").alias("y")).collect()]
    assert got == [1.01, 0.12, 0.38, 2.5, -0.12]


def test_t6_csv_text(spark):
    df = spark.createDataFrame([(0.12,), (None,), (-3.0,)], "x double")
    got = [r.y for r in df.select(X.fmt2("x").alias("y")).collect()]
    assert got == ["0.12", None, "-3.00"]


def test_t7_day_index_dense_over_present_days(spark):
    o = obs_frame(spark, [
        ("S1", "TMIN", "1980-01-01", 1), ("S1", "TMIN", "1980-03-01", 1), ("S1", "TMAX", "1980-02-29", 1),
        ("S2", "TMIN", "1980-12-31", 1),
    ])
    d = {(r.ID, r.MONTH, r.DAY_OF_MONTH): r.DAY for r in clim.daily_output(o).collect()}
    assert d == {("S1", 1, 1): 1, ("S1", 2, 29): 2, ("S1", 3, 1): 3, ("S2", 12, 31): 1}


def test_t8_ordinal_day_shares_feb29_and_mar1(spark):
    rows = [
        ("S1", dt.date(1971, 3, 1), 1.0, 2.0, 1.0, 2.0, 0.0),   # ordinal 60, normal year
        ("S1", dt.date(1972, 2, 29), 3.0, 4.0, 3.0, 4.0, 1.0),  # ordinal 60, leap year
        ("S1", dt.date(1969, 3, 1), 9.0, 9.0, 9.0, 9.0, 9.0),   # before the cut-off
    ]
    w = spark.createDataFrame(rows, "STATION string, DATE date, TMIN_P10 double, TMAX_P90 double, "
                                    "TMIN_MIN double, TMAX_MAX double, PRCP_SUM double")
    r = wd.agg_wide_by_ordinal_day(w).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.DAY, r.TMIN_P10, r.TMIN_MIN, r.TMAX_MAX, r.PRCP_SUM, r.MONTH, r.DAY_OF_MONTH) == (60, 2.0, 1.0, 4.0, 0.5, 3, 1)


def test_wide_means_keep_all_decimals(spark):
    values = [1.23456789012, 7.65432109876, 123456.789012345, -1e-7]
    rows = [("S1", dt.date(2001, 1, 1), *[v] * 5) for v in values]
    w = spark.createDataFrame(rows, "STATION string, DATE date, TMIN_P10 double, TMAX_P90 double, "
                                    "TMIN_MIN double, TMAX_MAX double, PRCP_SUM double")
    for r in (wd.agg_wide_by_ordinal_day(w).first(), wd.agg_wide_by_month(w).first()):
        assert r.TMIN_P10 == r.TMAX_P90 == r.PRCP_SUM == pytest.approx(sum(values) / 4, rel=1e-15)
        assert (r.TMIN_MIN, r.TMAX_MAX) == (-1e-7, 123456.789012345)


def test_t9_missing_element_gives_nulls_not_dropped_rows(spark):
    o = obs_frame(spark, [("S1", "PRCP", "1980-05-01", 3), ("S1", "TMIN", "1980-06-01", 10)])
    m = {r.MONTH: r for r in clim.monthly_output(o).collect()}
    assert set(m) == {5, 6}
    assert m[5].TMIN_P10 is None and m[5].PRCP_SUM == 3.0
    assert m[6].PRCP_SUM is None and m[6].TMIN_P10 == 1.0


def test_t10_t11_all_null_station_has_daily_but_no_monthly(spark):
    o = obs_frame(spark, [("S1", "TMIN", "1980-01-01", None), ("S2", "TMIN", "1980-01-01", 5)])
    assert {r.ID for r in clim.daily_output(o).collect()} == {"S1", "S2"}
    assert {r.ID for r in clim.monthly_output(o).collect()} == {"S2"}
    stations = spark.createDataFrame(
        [("S1", 1.0, 2.0), ("S2", 3.0, 4.0), ("S3", 5.0, 6.0)], "ID string, LATITUDE double, LONGITUDE double")
    f = {r.ID: r.MISSING for r in st.flag_missing(stations, clim.daily_output(o), clim.monthly_output(o)).collect()}
    assert f == {"S1": True, "S2": False, "S3": True}


def test_t12_entry_count_null_when_element_absent(spark):
    o = obs_frame(spark, [("S1", "TMIN", "1980-01-01", 1), ("S1", "TMAX", "1980-02-01", 1)])
    h = {r.MONTH: r for r in clim.history_output(o).collect()}
    assert h[1].TMIN_ENTRY_COUNT == 1 and h[1].TMAX_ENTRY_COUNT is None and h[1].PRCP_ENTRY_COUNT is None
    assert h[2].PERIOD_START == dt.date(1980, 2, 1)


def test_t13_strict_date_parse(spark):
    df = spark.createDataFrame([("19800101",), ("1980-01-01",)], "d string")
    assert df.select(X.parse_yyyymmdd("d", strict=False).alias("x")).collect()[1].x is None
    with pytest.raises(Exception):
        df.select(X.parse_yyyymmdd("d").alias("x")).collect()


FIXED_LINES = [
    "JA000047662  35.6830  139.7670   36.3    TOKYO                          GSN     47662",
    "CHM00054511  39.9330  116.2830   55.0    BEIJING                                54511",
    "",
    "USW00094728  40.7789  -73.9692   42.7 NY NEW YORK CNTRL PRK TWR             HCN 72506",
    "KSM00047108  37.5670  126.9670 -999.9    SEOUL",
]


def test_t14_fixed_width_fields(spark):
    lines = spark.createDataFrame([(x,) for x in FIXED_LINES], "value string")
    rows = {r.ID: r for r in parse_station_lines(lines).collect()}
    assert len(rows) == 4
    t = rows["JA000047662"]
    assert (t.LATITUDE, t.LONGITUDE, t.ELEVATION, t.STATE, t.NAME, t.GSN_FLAG, t.HCN_CRN_FLAG, t.WMO_ID) == (
        35.683, 139.767, 36.3, "", "TOKYO", "GSN", "", "47662")
    n = rows["USW00094728"]
    assert (n.STATE, n.NAME, n.HCN_CRN_FLAG, n.WMO_ID) == ("NY", "NEW YORK CNTRL PRK TWR", "HCN", "72506")
    s = rows["KSM00047108"]
    assert (s.ELEVATION, s.NAME, s.GSN_FLAG, s.WMO_ID) == (-999.9, "SEOUL", "", "")
    # the prefix filter rejects USW
    assert {r.ID for r in st.filter_station_prefix(parse_station_lines(lines)).collect()} == {
        "JA000047662", "CHM00054511", "KSM00047108"}


def test_t15_path_prefix(spark):
    df = spark.createDataFrame([("JA000047662",), ("CHM00054511",), ("JAW00012345",), ("UKE00105927",)], "ID string")
    got = [r.P for r in df.select(X.path_prefix("ID").alias("P")).collect()]
    assert got == ["JA", "CHM", "JAW", "UKE"]


def test_t16_no_quality_filter(spark, tmp_path):
    # extra (quality) columns in raw files are ignored, flagged rows are kept
    from stationclim.sources.observations import scan_obs_partitioned

    raw = spark.createDataFrame(
        [("S1", "19800101", 5, "X", "S1", "TMIN"), ("S1", "19800102", 7, "", "S1", "TMIN")],
        "ID string, DATE string, DATA_VALUE long, Q_FLAG string, STATION string, ELEMENT string")
    raw.write.partitionBy("STATION", "ELEMENT").parquet(str(tmp_path / "raw"))
    got = scan_obs_partitioned(spark, str(tmp_path / "raw"))
    assert got.columns == ["ID", "DATE", "DATA_VALUE", "ELEMENT"] and got.count() == 2


def test_cutoff_is_parameter(spark):
    o = obs_frame(spark, [("S1", "TMIN", "1969-12-31", 1), ("S1", "TMIN", "1970-01-01", 2)])
    assert clim.raw_counts(o).collect()[0].TMIN_raw_count == 1
    assert clim.raw_counts(o, cutoff=dt.date(1960, 1, 1)).collect()[0].TMIN_raw_count == 2


def test_date_labels(spark):
    df = spark.createDataFrame([(2021, 3, 7)], "YEAR int, MONTH int, DAY_OF_MONTH int")
    r = df.select(
        X.date_label("daily", "en").alias("a"), X.date_label("daily", "ja").alias("b"),
        X.date_label("monthly", "en").alias("c"), X.date_label("monthly", "zh").alias("d"),
        X.date_label("history", "en").alias("e"), X.date_label("history", "zh").alias("f"),
    ).collect()[0]
    assert tuple(r) == ("3-7", "3月7日", "3", "3月", "2021-03", "2021年3月")
