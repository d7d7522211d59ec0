"""Size-checked broadcasts and scale-dependent settings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A station-ID side of up to this many rows is broadcast (IDs are ~11 bytes:
# 2M rows stay far below the default 8 GB broadcast limit and the
# ~125k stations of a world station list fit with wide margin).
MAX_BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                       rows: int | None = None) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows.

    The row count (``rows``, or one cheap action on the small side itself) is
    the proof of the bound.  Beyond it the plain DataFrame is returned and
    Spark plans a shuffle join.
    """
    n = df.count() if rows is None else rows
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False


_FILE_ROWS: dict[tuple[str, str], int] = {}


def file_rows(spark, path: str) -> int:
    """Row count of an immutable input file set, counted once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _FILE_ROWS:
        _FILE_ROWS[key] = spark.read.parquet(path).count()
    return _FILE_ROWS[key]


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Suggested settings for a run over ``input_bytes`` of parquet input.

    The initial shuffle partition count is sized so a partition of the first
    (histogram) shuffle is about ``target_partition_bytes``; AQE then
    coalesces small partitions and splits skewed ones at run time.
    """
    parts = max(200, math.ceil(input_bytes / target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
    }


def write_bucketed_table(df: DataFrame, name: str, keys: Sequence[str] = ("ID",), buckets: int | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table bucketed by ``keys`` under the shared checkpoint folder.

    Cuts the lineage (executor loss re-reads files instead of recomputing), and
    the bucketed scan reports ``hashpartitioning(keys)``, so later groupings and
    windows keyed by a superset of them need no shuffle (an RDD checkpoint loses that).
    """
    import uuid

    from ..session import scratch_path

    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    n = min(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), most)
    path = scratch_path(spark, name)
    table = f"stationclim_{name}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._stationclim_table, out._stationclim_path = table, path  # for release()
    return out
