"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizing import write_bucketed_table
from ..session import drop_path, scratch_path

# Text bytes and rows that one numpy step inside a task works on.
SLICE_BYTES = 2_000_000
SLICE_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder, a folder for each value of ``by``, and read it back.

    Cuts the lineage: a lost executor costs a re-read of files instead of a
    recomputation, and generated row ids stay what they were.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def materialise_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``materialise`` as a table bucketed by ``key``: joins on it that follow shuffle their other side only.

    The rows are shuffled here once, into as many partitions as there are
    buckets, so that a bucket is written by one task.  The table's name is
    given up at once; its files stay until they are deleted.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    out = write_bucketed_table(df.repartition(n, key), name, [key], n)
    if _WRITTEN:
        _WRITTEN[-1].append(out._stationclim_path)
    spark.sql(f"DROP TABLE IF EXISTS {out._stationclim_table}")
    out._scratch = out._stationclim_path
    return out


_WRITTEN: list[list[str]] = []  # folders written inside each ``tidied`` call that runs


def tidied(make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``make`` returns, after the scratch folders that it wrote and that the frame does not read are deleted."""
    _WRITTEN.append([])
    try:
        out = make()
    finally:
        written = _WRITTEN.pop()
    segments = {part for f in out.inputFiles() for part in f.split("/")}
    for path in written:
        if path.rsplit("/", 1)[1] not in segments:
            drop_path(out.sparkSession, path)
        elif _WRITTEN:
            _WRITTEN[-1].append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a ``materialise``d frame (bucketed or not) that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        drop_path(df.sparkSession, path)


def fresh(name: str, taken) -> str:
    """``name``, lengthened until it clashes with no column in ``taken`` (names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of a value as text, modulo ``n``; null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n).cast("bigint"))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch while a step with wide rows runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = SLICE_BYTES,
           max_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with bounded rows and text bytes (one long text may exceed it alone)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < n:
        end = int(np.searchsorted(total, total[at] + max_bytes, "right")) - 1
        end = min(max(end, at + 1), at + max_rows, n)
        yield batch.slice(at, end - at)
        at = end


def append_columns(df: DataFrame, text: Column, fields: list[T.StructField],
                   make: Callable[[pa.Array], list[pa.Array]]) -> tuple[DataFrame, list[str]]:
    """All columns of ``df`` plus columns that ``make`` computes from the texts, batch by batch.

    Returns the frame and the names of the new columns, which clash with none
    of ``df``'s.  Null texts reach ``make`` as empty texts.
    """
    taken = list(df.columns)
    tcol = fresh("__text", taken)
    names = []
    for f in fields:
        names.append(fresh(f.name, [*taken, tcol, *names]))
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, fields)]])
    wide = df.select("*", F.coalesce(text.cast("string"), F.lit("")).alias(tcol))
    out_names = [*taken, *names]

    def run(batches):
        for batch in batches:
            for part in slices(batch, tcol):
                cols = make(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=out_names)

    return wide.mapInArrow(run, schema), names
