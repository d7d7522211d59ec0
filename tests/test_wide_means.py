"""Means of arbitrary doubles: exact, independent of order, defined for NaN, infinities and large values."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stationclim.functions.exact import mean_by_bins, text_round2
from stationclim.operators import wide as wd


def exact_mean(vs):
    vs = [v for v in vs if v is not None]
    if not vs:
        return None
    if any(math.isnan(v) for v in vs) or {math.inf, -math.inf} <= set(vs):
        return math.nan
    if any(math.isinf(v) for v in vs):
        return next(v for v in vs if math.isinf(v))
    total = sum(map(Fraction, vs))
    return float(total) / len(vs)


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b))))


def groups():
    rng = random.Random(6)
    out = {
        "tenths": [rng.randint(-400, 400) / 10 for _ in range(500)], "hundredths": [0.01, 0.02], "cancel": [1e22, -1e22, 0.5],
        "huge": [1e22, 1e22, 3.0], "max": [1.7976931348623157e308], "tiny": [5e-324, 5e-324, 1e-310], "wide": [1e300, 1.0, -1e300, 1e-300],
        "nan": [1.0, math.nan], "inf": [1.0, math.inf], "both": [math.inf, -math.inf, 2.0], "null": [None, None], "some": [None, 7.25],
        "zero": [0.0, -0.0, 0.0], "powers": [2.0 ** k for k in range(-60, 61, 7)], "negative": [-(2.0 ** k) - 1 for k in range(0, 60, 5)],
        "edges": [2.0 ** k * (1 + s * 2.0 ** -52) for k in range(-96, 97, 32) for s in (-1, 0, 1)]}
    for k in range(20):
        out[f"random{k}"] = [rng.gauss(0, 1) * 10 ** rng.randint(-8, 8) for _ in range(60)]
    return out


def test_means_are_exact_and_do_not_depend_on_order(spark):
    data = groups()
    rows = [(g, v, None if v is None else -v) for g, vs in data.items() for v in vs]
    want = {g: exact_mean(vs) for g, vs in data.items()}
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g string, v double, w double").repartition(3 + seed)
        got = {r.g: (r.v, r.w) for r in mean_by_bins(df, ["g"], ["v", "w"]).collect()}
        for g, m in want.items():
            v, w = got.get(g, (None, None))
            assert same(v, m), (g, v, m)
            assert same(w, None if m is None else -m if m else 0.0), (g, w, m)
        results.append(sorted(map(str, got.items())))
    assert results[0] == results[1]


def test_two_decimals_are_those_of_the_printed_double(spark):
    rng = random.Random(9)
    vs = [0.015, 0.125, 0.375, 1.005, 2.675, -0.125, -1.005, 0.005, 1e-10, 0.0, 99.995, 1e15 / 8, 1e22, -1e22, 12345678.125, 4.9e-324]
    vs += [rng.randint(-10 ** 6, 10 ** 6) / 1000 for _ in range(2000)] + [rng.randint(-(10 ** 5), 10 ** 5) / 8 for _ in range(1000)]
    vs += [rng.uniform(-1000, 1000) for _ in range(2000)] + [math.nextafter(k / 200, d) for k in range(-400, 400) for d in (-9, 9)]
    got = spark.createDataFrame([(v,) for v in vs], "v double").select("v", text_round2(F.col("v")).alias("r")).collect()
    for r in got:
        assert r.r == float(f"{r.v:.2f}"), r
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (None,)], "v double").select(text_round2(F.col("v")).alias("r")).collect()
    assert math.isnan(odd[0].r) and odd[1].r == math.inf and odd[2].r is None


@pytest.mark.parametrize("seed", [3, 4])
def test_wide_aggregates_against_plain_means(spark, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, rng.uniform(-50, 50), rng.randint(-300, 300) / 10, 1e22, math.nan] if rng.random() < 0.2 else [
        rng.uniform(-50, 50)])
    rows = [(rng.choice("AB"), dt.date(1969, 12, 25) + dt.timedelta(days=rng.randrange(900)), *[value() for _ in range(5)]) for _ in range(600)]
    cols = "TMIN_P10 double, TMAX_P90 double, TMIN_MIN double, TMAX_MAX double, PRCP_SUM double"
    df = spark.createDataFrame(rows, f"STATION string, DATE date, {cols}").repartition(5)
    want = defaultdict(list)
    for r in rows:
        if r[1].year >= 1970:
            want[r[0], r[1].month].append(r[2:])
    got = {(r.ID, r.MONTH): r for r in wd.agg_wide_by_month(df, decimals=2).collect()}
    assert set(got) == set(want)

    def shown(v):
        return v if v is None or math.isnan(v) or abs(v) >= 2 ** 46 else float(f"{v:.2f}")

    def extreme(fn, vs):
        vs = [v for v in vs if v is not None]
        real = [v for v in vs if not math.isnan(v)]
        return fn(real) if real else (math.nan if vs else None)

    for k, vs in want.items():
        c = list(zip(*vs))
        for name, v in (("TMIN_P10", exact_mean(c[0])), ("TMAX_P90", exact_mean(c[1])), ("PRCP_SUM", exact_mean(c[4])),
                        ("TMIN_MIN", extreme(min, c[2])), ("TMAX_MAX", extreme(max, c[3]))):
            assert same(got[k][name], shown(v)), (k, name)


def test_only_rows_without_values(spark):
    cols = "TMIN_P10 double, TMAX_P90 double, TMIN_MIN double, TMAX_MAX double, PRCP_SUM double"
    df = spark.createDataFrame([("A", dt.date(1980, 2, 29), *[None] * 5)], f"STATION string, DATE date, {cols}")
    got = wd.agg_wide_by_ordinal_day(df, decimals=2).collect()
    assert [tuple(r) for r in got] == [("A", 60, None, None, None, None, None, 2, 29)]
    assert wd.agg_wide_by_ordinal_day(df.limit(0)).count() == 0
