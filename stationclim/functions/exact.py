"""Means of doubles that do not depend on the order of rows, and their two-decimal text.

A finite double is an integer times a power of two.  Its exponent names a bin of
``BIN_BITS`` powers; within a bin every value is an integer multiple of one unit,
so the sum of a bin is an integer sum in ``decimal(38,0)``, exact for up to 10^12
values.  Bins are grouping keys, so sums are combined on the map side like any
other.  The few bins of a group are then added from the highest on, with the error of
each addition carried along, rounded once, and divided once by the count.

Rules:

* nulls do not count; a group of nulls has a null mean.
* NaN, or both infinities, give NaN; one infinity gives that infinity.
* bins whose sum is 0 are passed over, then the ``BINS`` highest count.  A lower
  bin is less than 2^-128 of the highest one's size; it could show only if the
  bins above it cancelled one another to the last bit.
* a sum beyond the largest double is an infinity.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 32
BINS = 6
_BIAS = 1088   # makes exponents positive before they are binned; a multiple of BIN_BITS above 1074
_PART = "decimal(38,0)"


def _times_power(x: Column, k: Column) -> Column:
    """x * 2^k in two exact steps, so that neither power leaves the range of a double."""
    half = F.floor(k / 2).cast("int")
    return x * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (k - half).cast("double"))


def bin_of(v: Column) -> Column:
    """Bin of a finite double; zero is in bin 0.

    At a power of two between bins the logarithm's rounding may choose either;
    a unit has one bit to spare for that.
    """
    a = F.abs(v)
    return F.when(a == 0.0, F.lit(0)).otherwise(F.floor((F.log2(a) + _BIAS) / BIN_BITS).cast("int"))


def _unit_exponent(b: Column) -> Column:
    """A bin's unit is two to this power: half the last bit of its smallest value."""
    return b * BIN_BITS - F.lit(_BIAS + 53)


def units_of(v: Column, b: Column) -> Column:
    """A finite double as an integer number of its bin's units (less than 2^88)."""
    x = _times_power(v, -_unit_exponent(b))
    # Beyond 2^62 a double is cut into two integers, since a cast to decimal takes the shortest text of a double.
    high = F.floor(x / F.lit(2.0 ** 40)).cast("double")
    low = x - high * F.lit(2.0 ** 40)
    return (high.cast("long").cast("decimal(20,0)") * F.lit(2 ** 40).cast("decimal(13,0)") + low.cast("long").cast("decimal(20,0)")).cast(_PART)


def _pieces(s: Column) -> list[Column]:
    """An integer sum as three doubles, highest first, that hold it exactly: bits from 100 on, 50 to 99, 0 to 49."""
    low = s % F.lit(2 ** 50).cast(_PART)
    middle = (s - low) % F.lit(str(2 ** 100)).cast(_PART)
    return [(s - low - middle).cast("double"), middle.cast("double"), low.cast("double")]


def _sum_of(parts: Column) -> Column:
    """Sum of an array of doubles from the first on, with the error of each addition carried along and added at the end."""

    def add(acc, x):
        s = acc["t"] + x
        back = s - acc["t"]
        return F.struct(s.alias("t"), (acc["e"] + ((acc["t"] - (s - back)) + (x - back))).alias("e"))

    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("e"))
    return F.aggregate(parts, start, add, lambda acc: acc["t"] + acc["e"])


def mean_by_bins(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                 ends: Mapping[str, tuple[Callable[[Column], Column], Column]] | None = None) -> DataFrame:
    """(keys, columns, ends): the mean of each double column per group, by exact binned sums.

    ``ends`` are further results by name, each ``(F.min or F.max, expression)``,
    taken in the same pass.
    """
    ends = dict(ends or {})
    cells = df.select(*keys, *[e.alias(name) for name, (_, e) in ends.items()],
                      F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_k", "_v"))
    v = F.col("_v")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))  # null for null
    binned = cells.withColumn("_b", F.when(finite, bin_of(v))).withColumn("_q", F.when(finite, units_of(v, F.col("_b"))))
    # Nulls and values that are not finite share the bin null; min and max tell which of them there are.
    odd = F.when(~finite, v)
    again = [fn(F.col(name)).alias(name) for name, (fn, _) in ends.items()]
    sums = binned.groupBy(*keys, "_k", "_b").agg(
        F.sum("_q").cast(_PART).alias("_s"), F.count("_v").alias("_n"), F.max(odd).alias("_top"), F.min(odd).alias("_low"), *again)
    sums = sums.repartition(*keys)  # the remaining steps are keyed by supersets of the keys
    some = F.col("_s").isNotNull() & (F.col("_s") != 0)
    rank = F.row_number().over(Window.partitionBy(*keys, "_k").orderBy(some.desc(), F.col("_b").desc()))
    picks = [F.max(F.when((F.col("_r") == r) & some, F.struct("_b", "_s"))).alias(f"_p{r}") for r in range(1, BINS + 1)]
    whole = sums.withColumn("_r", rank).groupBy(*keys, "_k").agg(
        F.sum("_n").alias("_n"), F.max("_top").alias("_top"), F.min("_low").alias("_low"), *picks, *again)
    top_unit = _unit_exponent(F.col("_p1._b"))
    bins = F.filter(F.array(*[F.col(f"_p{r}") for r in range(1, BINS + 1)]), lambda p: p.isNotNull())
    parts = F.flatten(F.transform(bins, lambda p: F.transform(
        F.array(*_pieces(p["_s"])), lambda q: _times_power(q, _unit_exponent(p["_b"]) - top_unit))))
    value = F.when(F.col("_n") > 0, F.coalesce(_times_power(_sum_of(parts), top_unit), F.lit(0.0)) / F.col("_n"))
    mean = F.when(F.isnan("_top") | (F.col("_top") > F.col("_low")), F.lit(float("nan"))).when(
        F.col("_top").isNotNull(), F.col("_top")).otherwise(value)
    flat = whole.select(*keys, "_k", mean.alias("_m"), *ends)
    return flat.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("_m"))).alias(c) for k, c in enumerate(columns)], *again)


def text_round2(x: Column) -> Column:
    """The double that has two decimals and is nearest to ``x``'s binary value, ties to the even hundredth.

    This is what printing ``x`` with two decimals shows.  (``rint(100 x)`` is not:
    the product is rounded first.)  NaN, infinities and doubles of 2^46 or more,
    which have hardly any hundredths, stay as they are.
    """
    a = F.abs(x)
    whole = F.floor(a).cast("double")
    f = a - whole
    fh = F.floor(f * F.lit(2.0 ** 26)).cast("double") / F.lit(2.0 ** 26)
    p, q = fh * 100.0, (f - fh) * 100.0     # both exact wherever the sum can be near a half
    s = p + q
    rest = q - (s - p)                      # s + rest = 100 f
    n = F.floor(s).cast("double")
    d = s - n
    odd = (n - F.floor(n / 2.0) * 2.0) == 1.0
    up = (d > 0.5) | ((d == 0.5) & ((rest > 0.0) | ((rest == 0.0) & odd)))
    cents = whole * 100.0 + n + F.when(up, 1.0).otherwise(0.0)
    sign = F.when(x < 0.0, -1.0).otherwise(1.0)
    return F.when(F.isnan(x) | (a >= F.lit(2.0 ** 46)), x).otherwise(sign * cents / 100.0)
