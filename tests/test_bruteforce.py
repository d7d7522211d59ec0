"""Spark pipeline vs a plain-Python model of the climatology, on random data.

The model follows the original algorithm step by step for each station and
element separately (filter, group by year-day / year-month, nearest-rank
quantile, second grouping, union of keys, row index, rounding) without any
of the engine's machinery (histograms, windows, pivots).
"""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as S

from conftest import obs_frame
from stationclim.operators import climatology as clim

ELEMS = ("TMIN", "TMAX", "PRCP")


def r2(x):
    return None if x is None else float(np.rint(x * 100.0) / 100.0)


def nearest(vals, q):
    v = sorted(vals)
    return v[int(np.floor((len(v) - 1) * q + 0.5))]


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def model(rows):
    """rows: (ID, ELEMENT, date, value|None) -> (daily, monthly) dicts."""
    by = defaultdict(list)
    for sid, e, d, v in rows:
        if d >= dt.date(1970, 1, 1):
            by[(sid, e)].append((d, v))
    daily, monthly = {}, {}
    stations = {s for s, _ in by}
    for sid in stations:
        dclim, mclim = {}, {}
        for e in ELEMS:
            obs = by.get((sid, e), [])
            div = 10.0 if e != "PRCP" else 1.0
            yd = defaultdict(list)
            for d, v in obs:
                yd[(d.year, d.month, d.day)].append(v)
            per_day = defaultdict(list)
            for (y, m, dd), vs in yd.items():
                nn = [v for v in vs if v is not None]
                per_day[(m, dd)].append((
                    nearest(nn, 0.1) if nn else None, nearest(nn, 0.9) if nn else None,
                    min(nn) if nn else None, max(nn) if nn else None, sum(nn)))
            for k, lst in per_day.items():
                mins = [x[2] for x in lst if x[2] is not None]
                maxs = [x[3] for x in lst if x[3] is not None]
                p10, p90, sm = mean([x[0] for x in lst]), mean([x[1] for x in lst]), mean([x[4] for x in lst])
                dclim[(e, k)] = (None if p10 is None else p10 / div, None if p90 is None else p90 / div,
                                 min(mins) / div if mins else None, max(maxs) / div if maxs else None,
                                 None if sm is None else sm / div)
            ym = defaultdict(list)
            for d, v in obs:
                if v is not None:
                    ym[(d.year, d.month)].append(v)
            per_month = defaultdict(list)
            for (y, m), vs in ym.items():
                per_month[m].append((nearest(vs, 0.1), nearest(vs, 0.9), min(vs), max(vs), sum(vs)))
            for m, lst in per_month.items():
                mclim[(e, m)] = (mean([x[0] for x in lst]) / div, mean([x[1] for x in lst]) / div,
                                 min(x[2] for x in lst) / div, max(x[3] for x in lst) / div,
                                 mean([x[4] for x in lst]) / div)
        dkeys = sorted({k for (_, k) in dclim})
        for i, k in enumerate(dkeys, start=1):
            g = lambda e, j: dclim.get((e, k), (None,) * 5)[j]
            daily[(sid, k[0], k[1])] = (i, r2(g("TMIN", 0)), r2(g("TMAX", 1)), r2(g("TMIN", 2)), r2(g("TMAX", 3)),
                                        r2(g("PRCP", 4)))
        for m in sorted({k for (_, k) in mclim}):
            g = lambda e, j: mclim.get((e, m), (None,) * 5)[j]
            monthly[(sid, m)] = (r2(g("TMIN", 0)), r2(g("TMAX", 1)), r2(g("TMIN", 2)), r2(g("TMAX", 3)), r2(g("PRCP", 4)))
    return daily, monthly


# Month edges around the cut-off and a leap day: few distinct calendar days, so groups collide.
DATES = [d for d in (dt.date(1968, 12, 25) + dt.timedelta(days=i) for i in range(1167))
         if d.day in (1, 2, 28, 29, 30, 31)]

row = S.tuples(
    S.sampled_from(["A", "B", "C"]),
    S.sampled_from(ELEMS),
    S.sampled_from(DATES),
    S.one_of(S.none(), S.integers(-300, 400)),
)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(S.lists(row, min_size=1, max_size=120))
def test_pipeline_matches_model(spark, rows):
    df = obs_frame(spark, [(s, e, d.isoformat(), v) for s, e, d, v in rows])
    exp_daily, exp_monthly = model(rows)
    got_daily = {
        (r.ID, r.MONTH, r.DAY_OF_MONTH): (r.DAY, r.TMIN_P10, r.TMAX_P90, r.TMIN_MIN, r.TMAX_MAX, r.PRCP_SUM)
        for r in clim.daily_output(df).collect()
    }
    got_monthly = {
        (r.ID, r.MONTH): (r.TMIN_P10, r.TMAX_P90, r.TMIN_MIN, r.TMAX_MAX, r.PRCP_SUM)
        for r in clim.monthly_output(df).collect()
    }
    assert got_daily == exp_daily
    assert got_monthly == exp_monthly


def test_model_on_fixed_random_data(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(800):
        d = dt.date(1969, 1, 1) + dt.timedelta(days=rnd.randint(0, 5 * 365))
        rows.append((rnd.choice("XYZ"), rnd.choice(ELEMS), d, rnd.choice([None] + list(range(-200, 300)))))
    df = obs_frame(spark, [(s, e, d.isoformat(), v) for s, e, d, v in rows])
    exp_daily, exp_monthly = model(rows)
    got_daily = {(r.ID, r.MONTH, r.DAY_OF_MONTH): (r.DAY, r.TMIN_P10, r.TMAX_P90, r.TMIN_MIN, r.TMAX_MAX, r.PRCP_SUM)
                 for r in clim.daily_output(df).collect()}
    got_monthly = {(r.ID, r.MONTH): (r.TMIN_P10, r.TMAX_P90, r.TMIN_MIN, r.TMAX_MAX, r.PRCP_SUM)
                   for r in clim.monthly_output(df).collect()}
    assert got_daily == exp_daily and got_monthly == exp_monthly
