"""Group summaries with exact nearest-rank quantiles.

A group's values are first reduced to a *value histogram* -- one row per
(group, value) with its multiplicity ``C``.  That aggregation is partial
(map-side), so a hot group with billions of duplicate rows is collapsed
before any shuffle, and the per-group work afterwards is bounded by the
number of *distinct* values, not by the number of rows.

The quantile is then read off the histogram with a running count over the
values in ascending order: the nearest-rank ``q`` quantile of ``n`` sorted
values is the value at 0-based index ``round((n - 1) * q)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import nearest_rank
from ..schema import P10, P90

DEFAULT_QUANTILES: Mapping[str, float] = {"P10": P10, "P90": P90}


def value_histogram(df: DataFrame, keys: Sequence[str], value: str = "DATA_VALUE") -> DataFrame:
    """(keys, value) -> multiplicity ``C``; null values form their own bucket."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("C"))


def summarize_histogram(hist: DataFrame, keys: Sequence[str], value: str = "DATA_VALUE",
                        quantiles: Mapping[str, float] = DEFAULT_QUANTILES,
                        null_sum_as_zero: bool = False) -> DataFrame:
    """Per group: quantiles, MIN, MAX, SUM and COUNT of the non-null values.

    ``COUNT`` counts non-null values.  ``SUM`` of a group whose values are
    all null is null, or 0 with ``null_sum_as_zero`` (the daily path).
    """
    v = F.col(value)
    nonnull_c = F.when(v.isNotNull(), F.col("C"))
    # Both frames share one ordering so Spark evaluates them in a single sort + window pass.
    ordered = Window.partitionBy(*keys).orderBy(v.asc_nulls_last())
    w_group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w_running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hist.withColumn("_N", F.sum(nonnull_c).over(w_group)).withColumn(
        "_CUM", F.sum("C").over(w_running)
    )

    aggs = []
    for name, q in quantiles.items():
        r = nearest_rank("_N", q)
        hit = v.isNotNull() & (F.col("_CUM") - F.col("C") <= r) & (r < F.col("_CUM"))
        aggs.append(F.max(F.when(hit, v)).alias(name))
    total = F.sum(v * F.col("C"))
    if null_sum_as_zero:
        total = F.coalesce(total, F.lit(0).cast("long"))
    aggs += [
        F.min(v).alias("MIN"),
        F.max(v).alias("MAX"),
        total.alias("SUM"),
        F.coalesce(F.sum(nonnull_c), F.lit(0).cast("long")).alias("COUNT"),
    ]
    return ranked.groupBy(*keys).agg(*aggs)


def summarize(df: DataFrame, keys: Sequence[str], value: str = "DATA_VALUE",
              quantiles: Mapping[str, float] = DEFAULT_QUANTILES,
              null_sum_as_zero: bool = False) -> DataFrame:
    """``value_histogram`` followed by ``summarize_histogram``."""
    return summarize_histogram(value_histogram(df, keys, value), keys, value, quantiles, null_sum_as_zero)
