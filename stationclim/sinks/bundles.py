"""Bundle layout: outputs of many stations in files of a bounded size.

``root/KIND=<kind>/PFX=<prefix>/RUN=<run>/part-*`` holds the lines of all kinds
with the station's ID in front, in the order of (ID, line), so a commit touches
one directory per kind and prefix instead of five per station.
``root/_bundle_index/RUN=<run>/`` names, for every (KIND, PFX, ID), the file its lines
are in and how many there are.  A later run supersedes an earlier one station by
station; its files lie beside the old ones, and the index tells which count.

CSV lines carry no header (the columns of a kind are fixed); a JSON line is
``<ID>,{...}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DAILY_COLUMNS, HISTORY_COLUMNS, MONTHLY_COLUMNS

MAX_LINES = 2_000_000  # lines of one file
INDEX = "_bundle_index"
INDEX_SCHEMA = "KIND string, PFX string, ID string, FILE string, LINES bigint, RUN string"
COLUMNS = {"daily": DAILY_COLUMNS, "monthly": MONTHLY_COLUMNS, "monthly-history": HISTORY_COLUMNS}


def index_path(root: str) -> str:
    return f"{root.rstrip('/')}/{INDEX}"


def _raw(spark: SparkSession, root: str) -> DataFrame:
    root = root.rstrip("/")
    schema = "value string, KIND string, PFX string, RUN string"
    lines = spark.read.schema(schema).option("basePath", root).text(f"{root}/KIND=*")
    return lines.select("KIND", "PFX", "RUN", F.substring_index("value", ",", 1).alias("ID"),
                        F.expr("substring(value, instr(value, ',') + 1)").alias("LINE"), F.col("_metadata.file_name").alias("FILE"))


def write_bundles(lines: DataFrame, root: str, run: str, done: DataFrame | None = None, max_lines: int = MAX_LINES) -> None:
    """Write ``csv_lines`` / ``json_lines`` (unioned) as bundles of ``run`` and index them.

    Stations and kinds in ``done`` are left out.  Lines are dealt by ranges of
    (KIND, PFX, ID, order), so a prefix with a large share of the stations is
    spread over several tasks and files.
    """
    root = root.rstrip("/")
    if done is not None:
        lines = lines.join(done.select("KIND", "PFX", "ID"), ["KIND", "PFX", "ID"], "left_anti")
    order = ["KIND", "PFX", "ID", "_ORD"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("KIND", "PFX", F.lit(run).alias("RUN"), F.concat_ws(",", "ID", "value").alias("value")).write.mode("append").option(
        "maxRecordsPerFile", max_lines).partitionBy("KIND", "PFX", "RUN").text(root)
    spark = lines.sparkSession
    written = f"{root}/KIND=*/PFX=*/RUN={run}"
    path = spark._jvm.org.apache.hadoop.fs.Path(written)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
        return  # nothing to write
    back = _raw(spark, root).where(F.col("RUN") == run)
    back.groupBy("KIND", "PFX", "ID", "FILE", "RUN").agg(F.count(F.lit(1)).alias("LINES")).select(
        "KIND", "PFX", "ID", "FILE", "LINES", "RUN").write.mode("append").partitionBy("RUN").parquet(index_path(root))


def bundle_index(spark: SparkSession, root: str) -> DataFrame:
    """(KIND, PFX, ID, FILE, LINES, RUN) of the files that count: those of each station's and kind's last run."""
    every = spark.read.schema(INDEX_SCHEMA).parquet(index_path(root))
    last = F.max("RUN").over(Window.partitionBy("KIND", "PFX", "ID"))
    return every.withColumn("_LAST", last).where(F.col("RUN") == F.col("_LAST")).drop("_LAST")


def scan_bundle_lines(spark: SparkSession, root: str) -> DataFrame:
    """(KIND, PFX, ID, LINE) of every line that counts."""
    current = bundle_index(spark, root).select("KIND", "PFX", "ID", "FILE", "RUN")
    return _raw(spark, root).join(current, ["KIND", "PFX", "ID", "FILE", "RUN"], "left_semi").select("KIND", "PFX", "ID", "LINE")


def scan_bundle_csv(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The rows of a CSV kind as text columns, PFX and ID in front; blank fields are null."""
    fields = F.split("LINE", ",", -1)
    cols = [F.when(fields[k] != "", fields[k]).alias(c) for k, c in enumerate(COLUMNS[kind])]
    return scan_bundle_lines(spark, root).where(F.col("KIND") == kind).select("PFX", "ID", *cols)
