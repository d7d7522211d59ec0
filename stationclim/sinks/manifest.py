"""Completion manifest of a station output root.

``root/_manifest/RUN=<run>/`` holds one row for every (KIND, PFX, ID) that a run
has finished.  It is written after the data, so a run that breaks off leaves
files without an entry, and the next run writes those stations again.  Readers
of ``root`` do not see the folder (its name begins with an underscore).

Two things follow from it: a run in ``ignore`` mode leaves finished stations out
before it scans an observation, and MISSING knows what earlier runs have written.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_manifest"
KEYS = ("KIND", "PFX", "ID")
SCHEMA = "KIND string, PFX string, ID string, RUN string"


def new_run() -> str:
    """A name for a run; later runs sort behind earlier ones."""
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f") + "-" + uuid.uuid4().hex[:8]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def path(root: str) -> str:
    return f"{root.rstrip('/')}/{FOLDER}"


def commit(keys: DataFrame, root: str, run: str) -> None:
    """Enter the (KIND, PFX, ID) of ``keys`` as finished by ``run``."""
    keys.select(*KEYS, F.lit(run).alias("RUN")).write.mode("append").partitionBy("RUN").parquet(path(root))


def listed(spark: SparkSession, root: str, parts=KEYS) -> DataFrame | None:
    """The partition directories under ``root``, by their names alone; None where there are none.

    Files are listed, never opened, and only below the first partition column,
    so other outputs beside them do not matter.
    """
    top = f"{root.rstrip('/')}/{parts[0]}=*"
    if not _exists(spark, top):
        return None
    found = spark.read.format("binaryFile").option("basePath", root).load(top)
    return found.select(*[F.col(c).cast("string").alias(c) for c in parts]).distinct()


def completed(spark: SparkSession, root: str) -> DataFrame | None:
    """(KIND, PFX, ID, RUN) of all finished outputs; None for a root that no run has written.

    A root without a manifest, written before there was one, is entered as it
    lies there, as one run that sorts first.
    """
    if not _exists(spark, path(root)):
        found = listed(spark, root)
        if found is None:
            return None
        commit(found, root, "00000000T000000-adopted")
    return spark.read.schema(SCHEMA).parquet(path(root))


def finished(done: DataFrame, *kinds: str) -> DataFrame:
    """IDs that have every one of ``kinds``."""
    has = [F.max((F.col("KIND") == k).cast("int")) for k in kinds]
    both = has[0]
    for h in has[1:]:
        both = both + h
    return done.where(F.col("KIND").isin(*kinds)).groupBy("ID").agg(both.alias("_N")).where(F.col("_N") == len(kinds)).select("ID")
