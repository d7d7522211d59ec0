"""Whitening against numpy's symmetric eigensolver, and the cases its docstring defines."""

from __future__ import annotations

import math

import numpy as np
import pytest

from stationclim.llm import whitening as W
from stationclim.llm.common import table

from .conftest import SF


def spectrum(v, k):
    e, x = np.linalg.eigh(v)
    return e[::-1][:k], x[:, ::-1][:, :k]


@pytest.mark.parametrize("name,v", [
    ("dense", np.cov(np.random.default_rng(0).normal(size=(40, 300)))), ("equal", np.diag([5.0] * 5 + [3.0] * 7 + [1.0] * 20)),
    ("low rank", (lambda a: a @ a.T)(np.random.default_rng(1).normal(size=(30, 5)))), ("one", np.array([[2.0]])),
    ("identity", np.eye(20)), ("graded", np.diag([1e6, 1e-3, 1e-9])), ("close", np.diag(1 + 1e-9 * np.arange(24.0)))])
def test_components(name, v):
    e, x = W.leading_components(v)
    want, _ = spectrum(v, len(e))
    scale = np.abs(v).max()
    assert len(e) == min(16, np.linalg.matrix_rank(v, tol=W.RANK_TOLERANCE * scale, hermitian=True))
    assert np.abs(e - want).max() <= 1e-13 * scale and np.abs(v @ x - x * e).max() <= 1e-12 * scale
    assert np.abs(x.T @ x - np.eye(len(e))).max() <= 1e-12


def test_inertia_counts():
    v = np.cov(np.random.default_rng(3).normal(size=(25, 200)))
    d, off = W.tridiagonal(v)
    e = np.linalg.eigvalsh(v)
    for s in np.linspace(e[0] - 0.1, e[-1] + 0.1, 41):
        assert W.inertia_above(d, off, s) == (e > s).sum()


def test_missed_component_is_an_error():
    v = np.diag([4.0, 3.0, 2.0, 1.0])
    with pytest.raises(ArithmeticError):
        W.feast(v, 1.5, 4.5, 2)  # the inertia of this interval is 3


def brute(rows, k):
    """{row number: (n, deviation, whitened, explained)}, and the covariance, from plain integers."""
    good = {i: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for i, v in rows.items()}
    distinct = sorted(set(good.values()))
    n, s = len(distinct), [sum(c) for c in zip(*distinct)]
    x = np.array(distinct, float) - np.array(s) / n
    v = x.T @ x / n
    e, w = spectrum(v, k)
    return {i: (n, sum((n * a - b) ** 2 for a, b in zip(q, s)), (np.array(q) - np.array(s) / n) @ w / np.sqrt(e), e / np.trace(v))
            for i, q in good.items()}


def check(got, want, k):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want) and len(got) == len(want) * k
    sign = None
    for i, (n, dev, z, share) in want.items():
        mine = by[i]
        assert sorted(mine) == list(range(1, k + 1))
        assert {(r.n, r.deviation, int(r.deviation_exact)) for r in mine.values()} == {(n, dev, dev)}
        a = np.array([mine[c].whitened for c in range(1, k + 1)])
        sign = np.sign(a * z) if sign is None else sign
        assert np.abs(a - sign * z).max() < 1e-6
        assert np.allclose([mine[c].explained for c in range(1, k + 1)], share, rtol=1e-9)
        assert all(0 <= r.identity_error <= 1e-8 for r in mine.values())


def test_query_against_brute_force(spark):
    rows = {r.vec_id: r.embedding for r in table(spark, SF, "embeddings").collect()}
    from stationclim.llm import queries

    check(queries.QUERIES["op13_feast_whitening"](spark, SF).collect(), brute(rows, 16), 16)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = {i: [float(c) for c in rng.normal(size=4)] for i in range(40)}
    rows[40] = rows[41] = rows[3]                          # copies count once in the fit
    rows[42] = [c + 1e-9 for c in rows[5]]                  # another vector, the same integers
    rows[43] = [3e5, -2e5, 1e5, 4e5]                        # wide entries are encoded wider
    rows[44] = [3e9, -2e9, 1e9, 4e9]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [1.0, 2.0, float("inf"), 0.0]),
           (104, []), (105, [1.0]), (106, [1e300, 0.0, 0.0, 0.0]), (107, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*rows.items(), *odd]],
                               "vec_id bigint, embedding array<double>, component int, dim string").repartition(5)
    got = W.whiten(df).collect()
    want = brute(rows, 4)
    assert {r.vec_id for r in got} == set(want)
    assert {(r.vec_id, int(r.deviation_exact)) for r in got} == {(i, q[1]) for i, q in want.items()}
    assert all(r.deviation in (None, int(r.deviation_exact)) for r in got) and any(r.deviation is None for r in got)
    assert all(r.identity_error < 1e-4 for r in got)
    again = W.whiten(df.repartition(2)).collect()
    key = lambda r: (r.vec_id, r.component)
    assert [(r.n, r.deviation_exact, r.whitened) for r in sorted(got, key=key)] == [
        (r.n, r.deviation_exact, r.whitened) for r in sorted(again, key=key)]


def test_null_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(None, rng.normal(size=3).tolist()), (1, rng.normal(size=3).tolist()), (1, rng.normal(size=3).tolist()),
            (2, rng.normal(size=3).tolist())] + [(9, rng.normal(size=3).tolist()) for _ in range(9)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert len(got) == 3 * len(rows) and sum(r.vec_id is None for r in got) == 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).count() == 0


def test_partial_sums_are_added_by_a_tree(spark):
    rows = [(i, 2, 3, f"{i} {-(10 ** 30)}") for i in range(600)]
    parts = spark.createDataFrame(rows, "k bigint, dim int, n bigint, s string").repartition(300)
    assert W._tree_sum(parts) == {2: (1800, [sum(range(600)), -600 * 10 ** 30])}
