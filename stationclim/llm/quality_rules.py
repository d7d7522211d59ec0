"""Quality rules: base counts, then robust multivariate outliers.

Base counts are taken from every whole text.  Texts that pass the base rules
are described by a vector of transformed statistics, and a
minimum-covariance-determinant (MCD) estimate of centre and scatter is made
for every (lang, source).  A text whose Mahalanobis distance from its group's
centre is too large is rejected.

The MCD runs as Spark aggregates over a group's distinct vectors, so that a
text that is copied counts once; every row is judged.  It starts at
coordinatewise medians and median deviations.  Each concentration step bins
the distances, keeps per group the least set of whole bins that holds the
half-set (n + p + 1) / 2, and takes that set's mean and covariance; one
``groupBy(group, bin)`` gives both.  Steps go on until no group's determinant
falls; each group keeps the estimate with its least one.  So nearly half of a group's distinct
vectors may lie anywhere without carrying the estimate away.  No group
is ever gathered: what leaves the map side is at most a few hundred bins a
group.  Vectors are integers (1/1024 units), so that sums do not depend on
the order of the rows.

Defined results
---------------
* null text: no words, ``n_words`` 0, base rule fails, not kept.
* null ``lang`` or ``source``: a value of its own.
* repeated rows: one vector of the estimate; each is answered.
* groups with fewer than ``MIN_GROUP`` vectors that passed are pooled by
  language, small languages with one another; where even that pool is small
  the base rules alone decide.
* a statistic that hardly varies in a group: ``FLOOR``, some units of rounding,
  keeps the steps' scatter regular; in the verdict ``LEAST`` bounds each
  statistic's scale from below.  The bound replaces a smaller variance and is
  not added to a larger one, and each statistic can reject a text alone.
* ties: a bin is kept or left whole.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizing import broadcast_if_small
from .common import append_columns, fresh, materialise

MIN_WORDS = 50          # fewer words fail the base rules
MAX_REPEAT_PERCENT = 50  # a larger share of words in repeated 3-word windows fails them
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

UNIT = 1024             # vectors are integers in 1/UNIT
DIM = 6
FLOOR = (1 / 64,) * DIM  # keeps the scatter of a concentration step regular
# Least scale of each statistic in the verdict (natural-log units): words, word length, symbols, repeated lines, repeated
# words, capitals.  One repeated line or phrase in an ordinary text must not reject it where most texts have none.
LEAST = (0.2, 0.05, 0.35, 0.85, 0.8, 0.2)
SUPPORT = 0.5           # the MCD covers this share of a group's vectors and of DIM + 1 more
MAX_STEPS = 20          # concentration steps; they end when no group's determinant falls any more
LEAST_FALL = 1e-3       # fall of a log determinant that counts
BINS = 16               # distance bins per unit of ln(1 + d^2)
MIN_GROUP = 100
TAIL_Z = 3.09           # normal quantile of the rejection tail, 0.999

_UPPER = bytes(range(ord("A"), ord("Z") + 1))

STATS = [T.StructField(n, T.LongType()) for n in
         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")]


def text_stats(text: str) -> tuple[int, ...]:
    """Counts of one text, in the order of ``STATS``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at 0x20 and 0x09-0x0D only
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        seen, twice = set(), set()
        for g in grams:
            (twice if g in seen else seen).add(g)
        reach = 0  # words before this one are counted
        for i, g in enumerate(grams):
            if g in twice:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated, len(lines), len(raw) - len(raw.translate(None, _UPPER)))


def _stats_arrays(texts: pa.Array) -> list[pa.Array]:
    rows = [text_stats(t) for t in texts.to_pylist()]
    return [pa.array(list(c), pa.int64()) for c in zip(*rows)]


def with_stats(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts appended, and where each count stands."""
    out, names = append_columns(docs, F.col(text), STATS, _stats_arrays)
    return out, {f.name: n for f, n in zip(STATS, names)}


def base_failed(c: dict[str, str]) -> Column:
    return (F.col(c["n_words"]) < MIN_WORDS) | (
        100 * F.col(c["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(c["n_words"]))


def vector(c: dict[str, str]) -> Column:
    """The transformed statistics as an array of integers in 1/UNIT."""
    n, chars = F.col(c["n_words"]) + 1, F.col(c["word_chars"]) + 1
    parts = [F.log(n), F.log(chars / n), F.log(1 + 1000 * F.col(c["n_symbols"]) / chars),
             F.log(1 + 100 * F.col(c["n_dup_lines"]) / (F.col(c["n_lines"]) + 1)),
             F.log(1 + 100 * F.col(c["n_repeat_words"]) / n), F.log(1 + 100 * F.col(c["n_upper"]) / chars)]
    return F.array(*[F.round(p * UNIT).cast("int") for p in parts])


def group_key(lang: str = "lang", source: str = "source") -> Column:
    return F.to_json(F.struct(F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s")))


def lang_key(lang: str = "lang") -> Column:
    return F.to_json(F.struct(F.col(lang).cast("string").alias("lang")))


def _pools(vectors: DataFrame, min_group: int) -> DataFrame:
    """(g, l) -> pool: the group itself, its language's small groups, or all small languages; null if too few."""
    sizes = vectors.groupBy("g", "l").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.where(F.col("n") < min_group)
    by_lang = small.groupBy("l").agg(F.sum("n").alias("ln"))
    rest = by_lang.where(F.col("ln") < min_group).agg(F.sum("ln").alias("rn"))
    return (sizes.join(by_lang, "l", "left").join(F.broadcast(rest), F.lit(True), "left")
            .select("g", F.when(F.col("n") >= min_group, F.concat(F.lit("g"), F.col("g")))
                    .when(F.col("ln") >= min_group, F.concat(F.lit("l"), F.col("l")))
                    .when(F.col("rn") >= min_group, F.lit("r")).alias("pool")))


def _solve(rows):
    """Sums of a pool -> centre and inverse scatter (floored); one small matrix a row."""
    import numpy as np
    import pandas as pd

    floor = np.diag((np.array(FLOOR) * UNIT) ** 2)
    for f in rows:
        out = []
        for r in f.itertuples(index=False):
            mean = np.array([getattr(r, f"s{i}") for i in range(DIM)]) / r.n
            cov = np.empty((DIM, DIM))
            for i in range(DIM):
                for j in range(i + 1):
                    cov[i, j] = cov[j, i] = getattr(r, f"q{i}_{j}") / r.n - mean[i] * mean[j]
            inv = np.linalg.inv(cov + floor)
            out.append((r.pool, mean.tolist(), inv.ravel().tolist(), float(np.linalg.slogdet(cov + floor)[1])))
        yield pd.DataFrame(out, columns=["pool", "mean", "inv", "logdet"])


def _bounded(rows):
    """Centre, inverse scatter and median distance of a pool -> the same centre, inverse scatter of the verdict.

    The scatter of a part of the rows is made consistent by the median
    distance; statistics without scatter have no share in that.  Then every
    variance is at least that of ``LEAST``.
    """
    import numpy as np
    import pandas as pd

    added, least = ((np.array(v) * UNIT) ** 2 for v in (FLOOR, LEAST))
    for f in rows:
        out = []
        for r in f.itertuples(index=False):
            cov = np.linalg.inv(np.array(r.inv).reshape(DIM, DIM))
            vary = max(1, int((np.diag(cov) > 2 * added).sum()))
            cov *= max(1.0, r.mid / chi2_quantile(0.0, vary))
            cov += np.diag(np.maximum(0.0, least - np.diag(cov)))
            out.append((r.pool, list(r.mean), np.linalg.inv(cov).ravel().tolist()))
        yield pd.DataFrame(out, columns=["pool", "mean", "inv"])


PARAMS = "pool string, mean array<double>, inv array<double>"


def _distance(x: Column, mean: Column, inv: Column) -> Column:
    """Squared Mahalanobis distance, written out over the fixed dimension."""
    d = [x[i] - mean[i] for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        total = total + d[i] * d[i] * inv[i * DIM + i]
        for j in range(i):
            total = total + 2.0 * d[i] * d[j] * inv[i * DIM + j]
    return F.greatest(total, F.lit(0.0))


def _with_distance(vectors: DataFrame, params: DataFrame) -> DataFrame:
    side, _ = broadcast_if_small(params, 100_000)
    return vectors.join(side, "pool").withColumn("d2", _distance(F.col("x"), F.col("mean"), F.col("inv")))


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and median absolute deviations from exact histograms with bins of 1/32."""
    step = UNIT // 32
    cells = materialise(vectors.select("pool", F.posexplode("x").alias("j", "v"))
                        .groupBy("pool", "j", F.floor(F.col("v") / step).alias("b")).agg(F.count(F.lit(1)).alias("k")), "mcd-cells")

    def medians(of: DataFrame, value: str) -> DataFrame:
        cum = of.select("pool", "j", value,
                        F.expr(f"sum(k) over (partition by pool, j order by {value})").alias("c"),
                        F.expr("sum(k) over (partition by pool, j)").alias("n"))
        return cum.groupBy("pool", "j").agg(F.min(F.when(F.col("c") >= 0.5 * F.col("n"), F.col(value))).alias("m"))

    mid = medians(cells, "b")
    away = medians(cells.join(mid, ["pool", "j"]).withColumn("d", F.abs(F.col("b") - F.col("m"))), "d").withColumnRenamed("m", "away")
    by = mid.join(away, ["pool", "j"]).withColumn("mid", (F.col("m") + 0.5) * step)
    scale = F.col("away") * step * 1.4826
    floor = F.element_at(F.array(*[F.lit(v * UNIT) for v in FLOOR]), F.col("j") + 1)
    by = by.select("pool", "j", "mid", (1.0 / (scale * scale + floor * floor)).alias("w"))
    wide = by.groupBy("pool").agg(*[F.max(F.when(F.col("j") == i, F.col(c))).alias(f"{c}{i}")
                                    for i in range(DIM) for c in ("mid", "w")])
    inv = [F.col(f"w{i}") if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)]
    return wide.select("pool", F.array(*[F.col(f"mid{i}") for i in range(DIM)]).alias("mean"), F.array(*inv).alias("inv"))


def _distance_bins(vectors: DataFrame, params: DataFrame, moments: bool) -> DataFrame:
    """Per pool and distance bin: rows and, if asked for, sums and cross sums; ``before`` counts nearer bins' rows."""
    x = [F.col("x")[i].cast("double") for i in range(DIM)]
    aggs = [F.count(F.lit(1)).alias("k")]
    if moments:
        aggs += [F.sum(x[i]).alias(f"s{i}") for i in range(DIM)]
        aggs += [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(DIM) for j in range(i + 1)]
    bins = (_with_distance(vectors, params)
            .groupBy("pool", F.floor(F.log1p("d2") * BINS).alias("b")).agg(*aggs))
    return bins.select("*", F.expr("sum(k) over (partition by pool order by b) - k").alias("before"),
                       F.expr("sum(k) over (partition by pool)").alias("total"))


def _step(vectors: DataFrame, params: DataFrame) -> DataFrame:
    inside = _distance_bins(vectors, params, True).where(F.col("before") < SUPPORT * (F.col("total") + DIM + 1))
    names = [f"s{i}" for i in range(DIM)] + [f"q{i}_{j}" for i in range(DIM) for j in range(i + 1)]
    sums = inside.groupBy("pool").agg(F.sum("k").alias("n"), *[F.sum(c).alias(c) for c in names])
    return sums.mapInPandas(_solve, PARAMS + ", logdet double")


def concentrate(vectors: DataFrame, params: DataFrame, max_steps: int = MAX_STEPS) -> tuple[DataFrame, int]:
    """The estimate of each pool with the least determinant over the concentration steps, and the steps taken.

    A pool is done when a step lowers its log determinant by less than
    ``LEAST_FALL``; later steps leave its rows out.
    """
    best = materialise(_step(vectors, params), "mcd-step0")
    going, steps = best, 1
    while steps < max_steps:
        last = best.join(going.select("pool"), "pool", "left_semi")
        step = materialise(_step(vectors, last), f"mcd-step{steps}")  # the join with ``last`` keeps the pools that go on
        old = best.select("pool", F.col("logdet").alias("before"))
        better = materialise(step.join(old, "pool").where(F.col("logdet") < F.col("before") - LEAST_FALL).drop("before"), "mcd-better")
        steps += 1
        if better.isEmpty():
            break
        best = materialise(best.join(better.select("pool"), "pool", "left_anti").unionByName(better), "mcd-best")
        going = better
    return best, steps


def chi2_quantile(z: float, p: int = DIM) -> float:
    """Wilson-Hilferty quantile of a chi-squared variable with ``p`` degrees at the normal quantile ``z``."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def estimate(vectors: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """MCD per group: (g, mean, inv), written to the scratch folder.

    ``vectors``: (g, l, x) of the rows that passed the base rules.  ``mean``
    and ``inv`` are null where a group's pool is too small.
    """
    vectors = materialise(vectors.distinct(), "mcd-vectors")
    pools = materialise(_pools(vectors, min_group), "mcd-pools")
    side, _ = broadcast_if_small(pools, 100_000)
    pooled = vectors.join(side, "g").where(F.col("pool").isNotNull()).select("pool", "x")
    params = materialise(_start(pooled), "mcd-start")
    params, _ = concentrate(pooled, params)
    params = params.drop("logdet")
    bins = _distance_bins(pooled, params, False)
    mid = (bins.where(F.col("before") + F.col("k") >= 0.5 * F.col("total")).groupBy("pool")
           .agg(F.expr(f"exp((min(b) + 0.5) / {BINS}) - 1").alias("mid")))
    bounded = params.join(mid, "pool").select("pool", "mean", "inv", "mid").mapInPandas(_bounded, PARAMS)
    out = pools.join(bounded, "pool", "left").select("g", "mean", "inv")
    return materialise(out, "mcd-params")


def _judged(stats: DataFrame, c: dict[str, str], params: DataFrame, extra: list[str]) -> DataFrame:
    """``stats`` with base_failed, outlier distance and verdict under the names in ``extra``."""
    side, _ = broadcast_if_small(params.withColumnsRenamed({k: f"__mcd_{k}" for k in params.columns}), 100_000)
    x = vector(c)
    failed, dist, kept = extra
    d2 = _distance(x, F.col("__mcd_mean"), F.col("__mcd_inv"))
    return (stats.join(side, F.col("__g") == F.col("__mcd_g"), "left")
            .withColumn(failed, base_failed(c)).withColumn(dist, d2)
            .withColumn(kept, ~F.col(failed) & F.coalesce(F.col(dist) <= chi2_quantile(TAIL_Z), F.lit(True))))


def _vectors(stats: DataFrame, c: dict[str, str]) -> DataFrame:
    return stats.where(~base_failed(c)).select(F.col("__g").alias("g"), F.col("__l").alias("l"), vector(c).alias("x"))


def robust_outliers(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, distance, kept."""
    narrow = docs.select("doc_id", "text", group_key().alias("__g"), lang_key().alias("__l"))
    stats, c = with_stats(narrow)
    stats = materialise(stats.drop("text"), "quality-stats")
    params = estimate(_vectors(stats, c), min_group)
    return _judged(stats, c, params, ["base_failed", "distance", "kept"]).select(
        "doc_id", *[F.col(c[n]).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "distance", "kept")


def keep_inliers(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    keyed = docs.select("*", group_key().alias("__g"), lang_key().alias("__l"))
    first, c1 = with_stats(keyed.select("text", "__g", "__l"))
    stats = materialise(first.drop("text"), "quality-stats")
    params = estimate(_vectors(stats, c1), min_group)
    again, c = with_stats(keyed)
    kept = fresh("__kept", again.columns)
    extra = [fresh("__failed", again.columns), fresh("__distance", again.columns), kept]
    return _judged(again, c, params, extra).where(F.col(kept)).select(*docs.columns)
