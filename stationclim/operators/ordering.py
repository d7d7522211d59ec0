"""Global order of a distributed frame as a column.

``with_position`` numbers rows 0, 1, 2, ... in the order of the given columns
without bringing them into one task: rows are range-partitioned and sorted, each
partition numbers its own rows, and the partitions' counts, summed up from the
first one on, give each partition its offset.  Only the counts (one row a
partition) meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_path, scratch_path

_PART, _ROW, _BEFORE = "__part", "__row", "__before"


def with_position(df: DataFrame, order: Sequence[str], name: str = "POSITION") -> DataFrame:
    """``df`` with the 0-based position of each row in the order of the columns ``order`` (nulls first).

    The input is evaluated once: the sorted rows are written to the shared
    scratch folder, so that offsets and rows agree after a lost executor.  Rows
    that tie in ``order`` are numbered in any order, so give all columns where
    the result must not vary.  ``release`` deletes the files.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits of the generated id count a partition's rows in its order.
    gid = F.monotonically_increasing_id()
    numbered = ranged.withColumns({_PART: F.shiftright(gid, 33), _ROW: gid.bitwiseAND(F.lit((1 << 33) - 1))})
    path = scratch_path(spark, "position")
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    upto = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    offsets = counts.select(_PART, (F.sum("__n").over(upto) - F.col("__n")).alias(_BEFORE))
    out = rows.join(F.broadcast(offsets), _PART).withColumn(name, F.col(_BEFORE) + F.col(_ROW)).drop(_PART, _ROW, _BEFORE)
    out._stationclim_scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the scratch files of a ``with_position`` frame that is no longer read."""
    path = getattr(df, "_stationclim_scratch", None)
    if path:
        drop_path(df.sparkSession, path)
