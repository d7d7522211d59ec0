"""The verdict of the robust quality rules against a plain numpy version, and the end of the concentration steps."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

from stationclim.llm import quality_rules as R
from stationclim.llm.common import table

SF = "/root/testdata/sf0.01"


def vector(stats):
    n_words, chars, symbols, dup, rep, lines, upper = stats
    n, c = n_words + 1, chars + 1
    parts = [math.log(n), math.log(c / n), math.log(1 + 1000 * symbols / c), math.log(1 + 100 * dup / (lines + 1)),
             math.log(1 + 100 * rep / n), math.log(1 + 100 * upper / c)]
    return tuple(math.floor(abs(p) * R.UNIT + 0.5) * (1 if p >= 0 else -1) for p in parts)


def distances(x, mean, inv):
    d = x - mean
    return np.maximum(np.einsum("ni,ij,nj->n", d, inv, d), 0.0)


def median_bin(values):
    """Least value with at least half of all values at or below it."""
    values = np.sort(values)
    return values[math.ceil(0.5 * len(values)) - 1]


def mcd(x):
    """(mean, inverse scatter of the verdict) of the distinct vectors ``x`` of one pool."""
    step, floor = R.UNIT // 32, np.diag((np.array(R.FLOOR) * R.UNIT) ** 2)
    b = np.floor(x / step)
    mid = np.array([median_bin(b[:, j]) for j in range(R.DIM)])
    away = np.array([median_bin(np.abs(b[:, j] - mid[j])) for j in range(R.DIM)])
    mean, inv = (mid + 0.5) * step, np.diag(1.0 / ((away * step * 1.4826) ** 2 + np.diag(floor)))
    best = None
    for _ in range(R.MAX_STEPS):
        cell = np.floor(np.log1p(distances(x, mean, inv)) * R.BINS)
        nearer = np.array([(cell < k).sum() for k in cell])
        part = x[nearer < R.SUPPORT * (len(x) + R.DIM + 1)]
        cov = np.cov(part.T, bias=True) + floor
        det = np.linalg.slogdet(cov)[1]
        if best is not None and det >= best[0] - R.LEAST_FALL:
            break
        mean, inv = part.mean(0), np.linalg.inv(cov)
        best = det, mean, inv
    _, mean, inv = best
    cell = np.sort(np.floor(np.log1p(distances(x, mean, inv)) * R.BINS))
    half = math.exp((cell[math.ceil(0.5 * len(cell)) - 1] + 0.5) / R.BINS) - 1
    cov = np.linalg.inv(inv)
    vary = max(1, int((np.diag(cov) > 2 * np.diag(floor)).sum()))
    cov = cov * max(1.0, half / R.chi2_quantile(0.0, vary))
    cov += np.diag(np.maximum(0.0, (np.array(R.LEAST) * R.UNIT) ** 2 - np.diag(cov)))
    return mean, np.linalg.inv(cov)


def test_verdicts_equal_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, (r.lang, r.source), R.text_stats(r.text or "")) for r in docs.collect()]
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, _, s in rows}
    groups, langs = defaultdict(set), defaultdict(set)
    for i, g, s in rows:
        if not failed[i]:
            groups[g].add(vector(s))
    minimum = 30
    small = {g for g, v in groups.items() if len(v) < minimum}
    for g in small:
        langs[g[0]] |= {(g, v) for v in groups[g]}
    pools = {g: np.array(sorted(v), float) for g, v in groups.items() if g not in small}
    for lang, v in langs.items():
        if len(v) >= minimum:
            pools |= {g: np.array(sorted(w for _, w in v), float) for g in small if g[0] == lang}
    assert len(pools) > 20 and small  # groups of their own, and small ones pooled by language
    fitted = {g: mcd(x) for g, x in pools.items()}
    got = {r.doc_id: r for r in R.robust_outliers(docs, min_group=minimum).collect()}
    assert set(got) == set(failed)
    cut, rejected = R.chi2_quantile(R.TAIL_Z), 0
    for i, g, s in rows:
        assert got[i].base_failed == failed[i]
        if failed[i] or g not in fitted:
            assert got[i].kept == (not failed[i])
            continue
        d = distances(np.array([vector(s)], float), *fitted[g])[0]
        assert abs(got[i].distance - d) <= 1e-6 * (1 + d), (i, g)
        if abs(d - cut) > 1e-6 * cut:
            assert got[i].kept == (d <= cut)
        rejected += d > cut
    assert rejected


def test_steps_end_where_the_determinant_stops_falling(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, R.UNIT / 2, (600, R.DIM))
    x[:250] = rng.normal(3 * R.UNIT, R.UNIT, (250, R.DIM))  # far and wide
    rows = [("p", [int(c) for c in r]) for r in x] + [("q", [int(c) for c in r]) for r in x[250:]]
    v = spark.createDataFrame(rows, f"pool string, x array<int>")
    start = R._start(v)
    best, steps = R.concentrate(v, start)
    one = {r.pool: r.logdet for r in R._step(v, start).collect()}
    end = {r.pool: r for r in best.collect()}
    assert set(end) == {"p", "q"} and 1 < steps < R.MAX_STEPS
    for pool, r in end.items():
        assert r.logdet <= one[pool]
    again = {r.pool: r.logdet for r in R._step(v, best).collect()}
    assert all(again[pool] >= r.logdet - R.LEAST_FALL for pool, r in end.items())
