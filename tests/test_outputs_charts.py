"""Column naming / order, element-absent columns, chart tables and comparison."""

from __future__ import annotations

import datetime as dt

import pytest

from conftest import obs_frame
from stationclim.operators import chart as ch
from stationclim.operators import climatology as clim
from stationclim.schema import DAILY_COLUMNS, HISTORY_COLUMNS, MONTHLY_COLUMNS


def test_rename_element_columns_and_order(spark):
    o = obs_frame(spark, [("S1", "TMAX", "1980-01-01", 5)])
    assert clim.daily_output(o).columns == ["ID", *DAILY_COLUMNS]
    assert clim.monthly_output(o).columns == ["ID", *MONTHLY_COLUMNS]
    assert clim.history_output(o).columns == ["ID", *HISTORY_COLUMNS]


def test_existing_columns_only_all_columns_exist(spark):
    # only TMAX present: the other elements' 12 value/count columns exist and are null
    o = obs_frame(spark, [("S1", "TMAX", "1980-01-01", 5)])
    r = clim.history_output(o).collect()[0].asDict()
    assert r["TMAX_MAX"] == 0.5 and r["TMAX_ENTRY_COUNT"] == 1
    assert all(r[c] is None for c in r if c.startswith(("TMIN_", "PRCP_")))


def test_history_precipitation_extremes_stay_integers(spark):
    o = obs_frame(spark, [("S1", "PRCP", "1980-01-01", 5), ("S1", "PRCP", "1980-01-02", 7)])
    h = clim.history_output(o)
    types = dict(h.dtypes)
    assert types["PRCP_SUM"] == "bigint" and types["PRCP_MIN"] == "bigint" and types["PRCP_P10"] == "double"
    assert h.collect()[0].PRCP_SUM == 12


def test_gap_flags_across_year_boundary(spark):
    rows = []
    for y, m in ((1980, 11), (1980, 12), (1981, 1), (1981, 4), (1981, 5)):
        for e in ("TMIN", "TMAX"):
            rows.append(("S1", e, f"{y}-{m:02d}-15", 10))
    hist = ch.chart_history_series(clim.history_output(obs_frame(spark, rows)))
    got = {(r.X.year, r.X.month): r.GAP for r in hist.collect()}
    assert got == {(1980, 11): False, (1980, 12): False, (1981, 1): False, (1981, 4): True, (1981, 5): False}
    mon = ch.chart_monthly_series(clim.monthly_output(obs_frame(spark, rows)))
    assert {r.X.month: r.GAP for r in mon.collect()} == {1: False, 4: True, 5: False, 11: True, 12: False}


def test_history_gap_counts_only_valid_rows(spark):
    rows = [("S1", "TMIN", "1980-01-15", 1), ("S1", "TMAX", "1980-01-15", 1),
            ("S1", "TMIN", "1980-02-15", 1),  # no TMAX: not a valid chart row
            ("S1", "TMIN", "1980-03-15", 1), ("S1", "TMAX", "1980-03-15", 1)]
    h = ch.chart_history_series(clim.history_output(obs_frame(spark, rows)))
    assert [(r.X, r.GAP, r.TMAX_ENTRY_COUNT) for r in h.orderBy("X").collect()] == [
        (dt.date(1980, 1, 1), False, 1), (dt.date(1980, 3, 1), True, 1)]


def test_axis_bounds(spark):
    rows = [("S1", "TMIN", "1980-01-15", -23), ("S1", "TMAX", "1980-01-15", 101)]
    b = ch.agg_axis_bounds(ch.chart_monthly_series(clim.monthly_output(obs_frame(spark, rows)))).collect()[0]
    assert (b.Y_MIN, b.Y_MAX) == (-5, 13)  # floor(-2.3) - 2, ceil(10.1) + 2


def test_compare_stations_validation(spark):
    rows = [(s, e, "1980-01-15", 10) for s in ("A", "B", "C", "D") for e in ("TMIN", "TMAX")]
    monthly = clim.monthly_output(obs_frame(spark, rows))
    with pytest.raises(ValueError):
        ch.compare_stations(monthly, ["A", "B", "C", "D"])
    out = ch.compare_stations(monthly, ["A", "B", "A"], tab="precipitation")
    assert out.columns == ["MONTH", "A_PRCP", "B_PRCP"]
    assert out.collect()[0]["A_PRCP"] == 0.0  # no precipitation -> 0
    with pytest.raises(ValueError):
        ch.chart_daily_series(monthly, variant="nope")
