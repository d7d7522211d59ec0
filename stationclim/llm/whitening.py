"""Embedding whitening: principal components by FEAST contour integration.

Entries become integers ``x = floor(64 c) + 1000000``; the fit list is every
distinct integer vector once, with covariance V (divisor n).  The leading
components of V are found interval by interval:

1. *Inertia.*  V is reduced to a tridiagonal T; the signs of the pivots of
   ``T - s I`` count the eigenvalues above any shift ``s``.  Bisection on these
   counts puts interval edges into the middle of gaps, a few eigenvalues to an
   interval.
2. *FEAST.*  For each interval the solves ``(z I - V) Q = Y`` at the complex
   quadrature nodes ``z`` of a circle through its edges, weighted and summed,
   project a block of vectors onto the interval's eigenspace; Rayleigh-Ritz on
   the projected block extracts the pairs, and the step is repeated until the
   residuals are at rounding.
3. *Verification.*  The pairs inside an interval must be as many as the inertia
   counts say; none is missed, none is found twice.

Spark holds the vectors.  Distinct vectors come from a hash aggregation over
encoded vectors (copies collapse on the map side) that is written once; sums
and centred second moments are taken per task in exact integers and added by a
tree of groups, so only one matrix of the dimension's size reaches the driver
and the order of rows changes nothing.  All rows are projected in one pass.

Defined results
---------------
* rows whose vector is null or holds a null, NaN or infinite entry: dropped; so
  are entries of 2^40 or more in size, whose ``x`` leaves no room for sums, and
  vectors of another length than the one with the most distinct vectors (ties:
  the longer).
* null or repeated ids, repeated rows: each remaining row is answered.
* fewer dimensions than components, or a covariance of lower rank: the
  components with a variance above rounding only (none: no rows).
* equal eigenvalues: some orthonormal basis of their space, the same for all rows.
* ``deviation`` beyond 64 bits: null there; ``deviation_exact`` has the value as
  a decimal.
* an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

SCALE, SHIFT = 64, 1_000_000  # fixed values of the integer form
COMPONENTS = 16
LARGEST = 2.0 ** 40           # entries of this size and more are dropped
FAN_IN = 128                  # partial sums that one task of the tree adds
NODES = 16                    # quadrature nodes of the whole circle
PER_INTERVAL = 6              # eigenvalues an interval aims at
MAX_SWEEPS = 40
RANK_TOLERANCE = 1e-12        # of the largest eigenvalue
_EXACT = 2.0 ** 53


# --------------------------------------------------------------------------- vectors

def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(row numbers, integer vectors without the shift)], one entry for each length; unusable rows are left out."""
    n = len(column)
    if not n:
        return []
    size = np.zeros(n, np.int64)
    ok = ~np.asarray(column.is_null())
    rows = column.filter(pa.array(ok)) if not ok.all() else column
    off = np.asarray(rows.offsets).astype(np.int64) if len(rows) else np.zeros(1, np.int64)
    size[ok] = np.diff(off)
    flat = rows.values.slice(off[0], off[-1] - off[0])
    v = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        v = np.floor(v * SCALE)
    good = np.abs(v) < LARGEST * SCALE  # false for NaN
    lost = np.concatenate([[0], np.cumsum(~good)])
    at = off - off[0]
    ok[ok] = lost[at[1:]] == lost[at[:-1]]
    first = np.zeros(n, np.int64)
    first[~np.asarray(column.is_null())] = at[:-1]
    out = []
    for d in np.unique(size[ok]):
        which = np.flatnonzero(ok & (size == d))
        out.append((which, v[first[which][:, None] + np.arange(d)]))
    return out


def _encode(x: np.ndarray) -> list[bytes]:
    """Equal integer vectors give equal bytes: the narrowest of 2, 4 and 8 bytes an entry, named in the first byte."""
    if not x.shape[1]:
        return [b"\x02"] * len(x)
    top = np.abs(x).max(1)
    width = np.where(top < 2 ** 15, 2, np.where(top < 2 ** 31, 4, 8))
    out = [b""] * len(x)
    for w in (2, 4, 8):
        which = np.flatnonzero(width == w)
        if which.size:
            part = x[which].astype(f"<i{w}")
            for k, row in zip(which.tolist(), part):
                out[k] = bytes([w]) + row.tobytes()
    return out


def _decode(blobs: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(blobs), dim))
    for w in (2, 4, 8):
        which = [k for k, b in enumerate(blobs) if b[0] == w]
        if which:
            out[which] = np.frombuffer(b"".join(blobs[k][1:] for k in which), f"<i{w}").reshape(len(which), dim)
    return out


def fit_list(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, x): every distinct integer vector once, encoded."""
    arrays = df.select(F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        for b in batches:
            for which, x in _matrix(b.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(which), x.shape[1], np.int32)), pa.array(_encode(x), pa.binary())], names=["dim", "x"])

    return arrays.mapInArrow(run, "dim int, x binary").distinct()


# --------------------------------------------------------------------------- exact sums

def _text(values) -> str:
    return " ".join(map(str, values))


def _tree_sum(partial: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{dim: (n, sums)} from rows (k, dim, n, s): integers as text, added by groups of ``FAN_IN`` rows until one group is left.

    What a task sends is one row a dimension, and a group adds at most
    ``FAN_IN`` rows of each.
    """
    width = max(1, partial.rdd.getNumPartitions())

    def add(key, batch):
        import pandas as pd

        total = None
        for t in batch["s"]:
            v = np.array([int(q) for q in t.split()], object)
            total = v if total is None else total + v
        return pd.DataFrame({"k": [key[0]], "dim": [key[1]], "n": [int(batch["n"].sum())], "s": [_text(total)]})

    while width > 1:
        partial = partial.withColumn("k", F.floor(F.col("k") / FAN_IN)).groupBy("k", "dim").applyInPandas(
            add, "k bigint, dim int, n bigint, s string")
        width = math.ceil(width / FAN_IN)
    found: dict[int, tuple[int, list[int]]] = {}
    for r in partial.collect():  # one row a dimension
        n, s = found.get(r["dim"], (0, None))
        mine = [int(q) for q in r["s"].split()]
        found[r["dim"]] = (n + r["n"], mine if s is None else [a + b for a, b in zip(s, mine)])
    return found


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _partials(points: DataFrame, measure, extra: str = "") -> DataFrame:
    """Rows (k, dim, n, s): ``measure(x)`` (a vector of exact numbers) summed over a task's vectors, per dimension."""

    def run(batches):
        total: dict[int, list] = {}
        for b in batches:
            dims = np.asarray(b.column(0))
            for d in np.unique(dims).tolist():
                blobs = b.column(1).filter(pa.array(dims == d)).to_pylist()
                s = measure(_decode(blobs, d))
                if d in total:
                    total[d][0] += len(blobs)
                    total[d][1] = total[d][1] + s
                else:
                    total[d] = [len(blobs), s]
        k = _task()
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([d], pa.int32()), pa.array([n], pa.int64()),
                                              pa.array([_text(s)], pa.string())], names=["k", "dim", "n", "s"])

    return points.mapInArrow(run, "k bigint, dim int, n bigint, s string")


def _objects(x: np.ndarray) -> np.ndarray:
    return np.array([int(q) for q in x.ravel()], object).reshape(x.shape)


def _column_sums(x: np.ndarray) -> np.ndarray:
    exact = not x.size or np.abs(x).max() * len(x) < _EXACT
    return _objects(x.sum(0)) if exact else _objects(x).sum(0)


def _second_moments(x: np.ndarray) -> np.ndarray:
    """Upper triangle of x'x in exact integers."""
    upper = np.triu_indices(x.shape[1])
    exact = not x.size or np.abs(x).max() ** 2 * len(x) < _EXACT
    if exact:
        return _objects((x.T @ x)[upper])
    y = _objects(x)
    return (y.T @ y)[upper]


def moments(points: DataFrame):
    """(dim, n, S, V) of the fit list's commonest dimension; None for an empty list.

    S holds exact sums of ``x``; V comes from exact integer moments around the
    rounded mean and is rounded once, at the end.
    """
    sums = _tree_sum(_partials(points, _column_sums))
    if not sums:
        return None
    dim = max(sums, key=lambda d: (sums[d][0], d))
    n, s = sums[dim]
    centre = [round(q / n) for q in s]
    rest = [q - n * c for q, c in zip(s, centre)]
    if dim == 0:
        return 0, n, [], np.zeros((0, 0))
    around = np.array(centre, float)
    _, m = _tree_sum(_partials(points.where(F.col("dim") == dim), lambda x: _second_moments(x - around)))[dim]
    v = np.empty((dim, dim))
    i, j = np.triu_indices(dim)
    for a, b, q in zip(i.tolist(), j.tolist(), m):
        v[a, b] = v[b, a] = (q * n - rest[a] * rest[b]) / (n * n)  # integers; one rounding
    return dim, n, [q + n * SHIFT for q in s], v


# --------------------------------------------------------------------------- eigenvalues in an interval

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        u = a[k + 1:, k].copy()
        norm = np.linalg.norm(u)
        if norm == 0.0:
            continue
        u[0] += math.copysign(norm, u[0])
        u /= np.linalg.norm(u)
        p = a[k + 1:, k + 1:] @ u
        q = p - (u @ p) * u
        a[k + 1:, k + 1:] -= 2.0 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1, k] = a[k, k + 1] = -math.copysign(norm, a[k + 1, k])
        a[k + 2:, k] = a[k, k + 2:] = 0.0
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia_above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: positive pivots of the shifted matrix (Sylvester's law)."""
    tiny = np.finfo(float).tiny ** 0.5
    count, d = 0, 1.0
    for a, b in zip(diagonal.tolist(), [0.0, *(off * off).tolist()]):
        d = a - shift - b / d
        if abs(d) < tiny:
            d = -tiny
        count += d > 0
    return count


def _edges(above, low: float, high: float, wanted: int, resolution: float) -> list[tuple[float, int]]:
    """[(shift, eigenvalues above it)], falling, from none above to at least ``wanted`` above, in the middle of gaps.

    The first shift lies as close above the largest eigenvalue as the width of its interval allows.
    """

    def bisect(lo: float, hi: float, enough) -> tuple[float, float]:
        while hi - lo > resolution:
            mid = 0.5 * (lo + hi)
            lo, hi = (mid, hi) if enough(above(mid)) else (lo, mid)
        return lo, hi

    out = [(high, 0)]
    while out[-1][1] < wanted:
        target = min(out[-1][1] + PER_INTERVAL, wanted)
        eigen, _ = bisect(low, out[-1][0], lambda c: c >= target)       # just below the target-th eigenvalue
        count = above(eigen)                                            # equal eigenvalues come together
        after, _ = bisect(low, eigen, lambda c: c > count) if count < above(low) else (low, low)
        out.append((0.5 * (after + eigen), count))
    _, largest = bisect(out[1][0], high, lambda c: c > 0)
    out[0] = (largest + 0.25 * (largest - out[1][0]), 0)
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` with low < e < high, falling, by contour integration and Rayleigh-Ritz."""
    n = len(v)
    block = min(n, count + max(4, count // 2))
    centre, radius = 0.5 * (low + high), 0.5 * (high - low)
    node, weight = np.polynomial.legendre.leggauss(NODES // 2)
    angle = -0.5 * np.pi * (node - 1.0)  # the upper half circle; the lower one is its conjugate
    y = np.random.default_rng(seed).normal(size=(n, block))
    scale = np.abs(v).sum(1).max()
    eye, best, previous = np.eye(n), None, np.inf
    for _ in range(MAX_SWEEPS):
        q = np.zeros((n, block))
        for w, t in zip(weight, angle):
            turn = radius * np.exp(1j * t)
            q += 0.5 * w * (turn * np.linalg.solve((centre + turn) * eye - v, y.astype(complex))).real
        q, _ = np.linalg.qr(q)
        q, _ = np.linalg.qr(q)
        e, s = np.linalg.eigh(q.T @ v @ q)
        y = q @ s
        inside = np.flatnonzero((e > low) & (e < high))
        if inside.size == count:
            x = y[:, inside]
            error = np.abs(v @ x - x * e[inside]).max() if count else 0.0
            if best is None or error < previous:
                best, stalled = (e[inside], x), error > 0.5 * previous
                previous = error
            else:
                stalled = True
            if error <= 1e-15 * scale or (stalled and previous <= 1e-12 * scale):
                order = np.argsort(-best[0], kind="stable")
                return best[0][order], best[1][:, order]
    raise ArithmeticError(f"{count} eigenvalues counted in ({low}, {high}), not found in {MAX_SWEEPS} sweeps")


def leading_components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above rounding, falling, at most ``wanted``, and their unit vectors as columns."""
    n = len(v)
    radius = np.abs(v).sum(1).max() if n else 0.0
    if radius == 0.0:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, off = tridiagonal(v)
    above = lambda shift: inertia_above(diagonal, off, shift)
    wanted = min(wanted, above(RANK_TOLERANCE * radius))
    low, high = -0.01 * radius, 1.01 * radius
    edges = _edges(above, low, high, wanted, 1e-13 * radius)
    values, vectors = [], []
    for (top, before), (bottom, upto) in zip(edges[:-1], edges[1:]):
        e, x = feast(v, bottom, top, upto - before)
        values.append(e)
        vectors.append(x)
    if sum(map(len, values)) != edges[-1][1]:
        raise ArithmeticError("components missed")
    # One Rayleigh-Ritz step over all intervals: vectors on both sides of a narrow gap become orthogonal.
    q, _ = np.linalg.qr(np.concatenate(vectors, 1))
    e, s = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-e, kind="stable")[:wanted]
    return e[order], (q @ s)[:, order]


# --------------------------------------------------------------------------- all rows

def _whitened(x: np.ndarray, model: dict) -> np.ndarray:
    return ((x - model["centre"]) - model["rest"]) @ model["project"]


def fit(points: DataFrame, components: int = COMPONENTS) -> dict | None:
    """The whitening model of a fit list; None where it has no vector or no component."""
    found = moments(points)
    if found is None:
        return None
    dim, n, s, v = found
    e, w = leading_components(v, components)
    if not e.size:
        return None
    centre = [round(q / n) - SHIFT for q in s]
    rest = [q - n * (c + SHIFT) for q, c in zip(s, centre)]
    model = {"dim": dim, "n": n, "s": s, "centre": np.array(centre, float), "rest": np.array([q / n for q in rest]),
             "shift": rest, "values": e, "project": w / np.sqrt(e), "explained": e / np.trace(v)}
    model["error"] = identity_error(points.where(F.col("dim") == dim), model)
    return model


def identity_error(points: DataFrame, model: dict) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity), measured on the whitened vectors.

    Products are rounded to 2^-40 so that the sum over tasks is exact.
    """
    k = len(model["values"])
    upper = np.triu_indices(k)

    def measure(x: np.ndarray) -> np.ndarray:
        z = _whitened(x, model)
        return _objects(np.rint(np.concatenate([z.sum(0), (z.T @ z)[upper]]) * 2.0 ** 40))

    n, s = _tree_sum(_partials(points, measure))[model["dim"]]
    mean = [q / n for q in s[:k]]
    return max(abs((q / n - mean[i] * mean[j] / 2.0 ** 40) / 2.0 ** 40 - (i == j)) for i, j, q in zip(*upper, s[k:]))


def _deviations(x: np.ndarray, model: dict) -> list[int]:
    """sum over dimensions of (n x - S)^2 for each row, in exact integers."""
    n, rest = model["n"], model["shift"]
    u = x - model["centre"]
    top = float(np.abs(u).max(initial=0.0))
    most = max(map(abs, rest), default=0)
    if top ** 2 * u.shape[1] < _EXACT and (float(n) * top + most) ** 2 * u.shape[1] < 2.0 ** 62:
        a = n * u.astype(np.int64) - np.array(rest, np.int64)
        return (a * a).sum(1).tolist()
    r = np.array(rest, object)
    a = n * _objects(u) - r
    return list((a * a).sum(1))


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining row of ``df`` and component: the whitened coordinates and the fit's figures."""
    id_type = df.schema[id_col].dataType
    out = T.StructType([
        T.StructField("vec_id", id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
        T.StructField("deviation_exact", T.DecimalType(38, 0))])
    model = fit(materialise(fit_list(df, vector), "white-points"), components)
    if model is None:
        return df.sparkSession.createDataFrame([], out)
    pairs = df.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    k, names = len(model["values"]), out.fieldNames()

    def run(batches):
        from decimal import Decimal

        for b in batches:
            for which, x in _matrix(b.column(1)):
                if x.shape[1] != model["dim"] or not len(which):
                    continue
                at = pa.array(np.repeat(which, k))
                exact = _deviations(x, model)
                long = pa.array([q if q < 2 ** 63 else None for q in exact], pa.int64())
                each = pa.array(np.repeat(np.arange(len(which)), k))
                rows = len(which) * k
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(which))),
                    pa.array(np.full(rows, model["n"], np.int64)), long.take(each), pa.array(_whitened(x, model).ravel()),
                    pa.array(np.tile(model["explained"], len(which))), pa.array(np.full(rows, model["error"])),
                    pa.array([Decimal(q) for q in exact], pa.decimal128(38, 0)).take(each)], names=names)

    return pairs.mapInArrow(run, out)
