"""Output writers.

Per-station outputs are written as one partitioned dataset per kind
(``PFX=<prefix>/ID=<station>/part-*.csv``) by the tasks that computed them;
nothing is funnelled through the driver or a single task.

``mode`` is the Spark save mode: ``"ignore"`` skips an existing output,
``"overwrite"`` replaces it.  With ``dynamic=True`` an overwrite only
replaces the station directories present in the new data.

Outputs arrive clustered by (ID, MONTH).  The lines of a station's file, bounded
by the calendar and the number of months, are brought together by (KIND, PFX,
ID) when they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fmt2, path_prefix
from ..operators.ordering import release, with_position
from ..schema import DAILY_COLUMNS, ELEMENTS, HISTORY_COLUMNS, MONTHLY_COLUMNS, WIDE_DAILY_COLUMNS, WIDE_MONTHLY_COLUMNS
from . import manifest

COLUMNS = {
    "daily": DAILY_COLUMNS,
    "monthly": MONTHLY_COLUMNS,
    "history": HISTORY_COLUMNS,
    "wide_daily": WIDE_DAILY_COLUMNS,
    "wide_monthly": WIDE_MONTHLY_COLUMNS,
}


def _writer(df: DataFrame, mode: str, dynamic: bool):
    w = df.write.mode(mode)
    if dynamic and mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    return w


def csv_text_columns(df: DataFrame, kind: str) -> DataFrame:
    """Format an assembled output as CSV text: floats with 2 decimals, integers plain, null empty."""
    out = []
    for c in COLUMNS[kind]:
        t = df.schema[c].dataType.typeName()
        if t in ("double", "float"):
            out.append(fmt2(c).alias(c))
        elif t == "date":
            out.append(F.date_format(c, "yyyy-MM-dd").alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return df.select("ID", *out)


def write_merged_parquet(obs: DataFrame, root: str, mode: str = "overwrite", partitions: int | None = None) -> None:
    """Observations as ``root/ELEMENT=<e>/``, files sorted by (ID, DATE).

    Range partitioning on (ELEMENT, ID, DATE) samples the key distribution, so
    a station with a large share of rows is split over several files by DATE.
    """
    df = obs.select("ID", "DATE", "DATA_VALUE", "ELEMENT")
    df = df.repartitionByRange(partitions, "ELEMENT", "ID", "DATE") if partitions else df.repartitionByRange(
        "ELEMENT", "ID", "DATE"
    )
    df.sortWithinPartitions("ELEMENT", "ID", "DATE").write.mode(mode).partitionBy("ELEMENT").parquet(root)


def write_station_csv(df: DataFrame, root: str, kind: str, mode: str = "overwrite", dynamic: bool = True) -> None:
    """One CSV file (with header) per station under ``root/PFX=<p>/ID=<id>/``.

    Goes through ``csv_lines`` and ``write_lines``: every station gets exactly
    one file, header first.
    """
    write_lines(csv_lines(df, kind), root, mode, dynamic, by_kind=False)


def summary_frame(counts: DataFrame, history_rows: DataFrame | None = None) -> DataFrame:
    """Run summary per station: raw counts and (monthly runs) history rows."""
    cols = [F.col("ID")] + [F.col(f"{e}_raw_count") for e in ELEMENTS]
    if history_rows is None:
        return counts.select(*cols)
    return counts.join(history_rows, "ID", "left").select(*cols, F.col("monthly_history_rows"))


def write_summary_json(summary: DataFrame, root: str, mode: str = "overwrite", dynamic: bool = True) -> None:
    """One JSON object per station under ``root/PFX=<p>/ID=<id>/`` (null fields omitted)."""
    out = summary.withColumn("PFX", path_prefix("ID"))
    _writer(out, mode, dynamic).partitionBy("PFX", "ID").json(root)


GEOJSON_HEAD = '{"type":"FeatureCollection","features":['
GEOJSON_TAIL = "]}"


def write_geojson(features: DataFrame, root: str) -> None:
    """A FeatureCollection as ordered text parts under ``root``; an earlier one is replaced.

    Lines are sorted by (ID, feature) and written in the order of their position,
    so the part files concatenated in name order form one GeoJSON document.  Every
    feature but the one at position 0 carries a leading comma; equal IDs are
    features like any other.  ``features`` is evaluated once.
    """
    spark = features.sparkSession
    placed = with_position(features.select("ID", "FEATURE"), ["ID", "FEATURE"])
    try:
        value = F.when(F.col("POSITION") == 0, F.col("FEATURE")).otherwise(F.concat(F.lit(","), F.col("FEATURE")))
        body = placed.select("POSITION", value.alias("value"))
        frame = spark.createDataFrame([(-1, GEOJSON_HEAD), (2**63 - 1, GEOJSON_TAIL)], "POSITION bigint, value string")
        frame.unionByName(body).orderBy("POSITION").select("value").write.mode("overwrite").text(root)
    finally:
        release(placed)


def read_geojson_features(spark, root: str) -> DataFrame:
    """Feature lines of a ``write_geojson`` output (header and footer dropped)."""
    lines = spark.read.text(root)
    feats = lines.where(F.col("value").startswith('{"type":"Feature"') | F.col("value").startswith(',{"type":"Feature"'))
    return feats.select(F.regexp_replace("value", "^,", "").alias("FEATURE"))


# --------------------------------------------------------------------------- one-pass writer

def _int(c: str) -> F.Column:
    return F.col(c).cast("long")


# Row order within a station file, from the (text) CSV columns.
_ORDER_KEY = {
    "daily": lambda: _int("MONTH") * 100 + _int("DAY_OF_MONTH"),
    "monthly": lambda: _int("MONTH"),
    "history": lambda: _int("YEAR") * 100 + _int("MONTH"),
    "wide_daily": lambda: _int("DAY"),
    "wide_monthly": lambda: _int("MONTH"),
}


def _lines(df: DataFrame, label, order, head: str | None, value) -> DataFrame:
    return df.select(label.alias("KIND"), path_prefix("ID").alias("PFX"), "ID", order.alias("_ORD"),
                     F.lit(head).cast("string").alias("_HEAD"), value.alias("value"))


def csv_lines(df: DataFrame, kind: str, label: str | None = None) -> DataFrame:
    """(KIND, PFX, ID, _ORD, _HEAD, value): one text line per row.

    Fields hold numbers and dates only, so no quoting is needed; null is an
    empty field.  ``_ORD`` orders rows within a station file, ``_HEAD`` is the
    file's header line.
    """
    text = csv_text_columns(df, kind)
    fields = [F.coalesce(F.col(c), F.lit("")) for c in COLUMNS[kind]]
    return _lines(text, F.lit(label or kind), _ORDER_KEY[kind](), ",".join(COLUMNS[kind]), F.concat_ws(",", *fields))


def json_lines(df: DataFrame, label: str) -> DataFrame:
    """(KIND, PFX, ID, _ORD, _HEAD, value) with one JSON object per row (null fields omitted) and no header."""
    payload = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "ID"]))
    return _lines(df, F.lit(label), F.lit(0).cast("long"), None, payload)


def write_lines(lines: DataFrame, root: str, mode: str = "overwrite", dynamic: bool = True,
                by_kind: bool = True, done: DataFrame | None = None) -> None:
    """Write ``csv_lines`` / ``json_lines`` (unioned) as ``root/KIND=/PFX=/ID=/part-*``.

    One job writes every kind; within a station file the header comes first
    and rows follow in ``_ORD`` order.  ``by_kind=False`` drops the KIND level.
    ``mode="ignore"`` leaves the stations and kinds of ``done`` as they are
    (default: those whose directories are there) and writes the others; what
    an unfinished run has left of these is replaced.
    """
    parts = ["KIND", "PFX", "ID"] if by_kind else ["PFX", "ID"]
    if mode == "ignore":
        if done is None:
            done = manifest.listed(lines.sparkSession, root, parts)
        if done is not None:
            lines = lines.join(done.select(*parts), parts, "left_anti")
        mode, dynamic = "overwrite", True
    value = F.col("value")
    if "_HEAD" in lines.columns:
        # The window brings each file's lines into one task.
        first = F.col("_ORD") == F.min("_ORD").over(Window.partitionBy(*parts))
        value = F.when(first & F.col("_HEAD").isNotNull(), F.concat("_HEAD", F.lit("\n"), "value")).otherwise(value)
    ordered = lines.select(*parts, "_ORD", value.alias("value")).sortWithinPartitions(*parts, "_ORD")
    _writer(ordered.select(*parts, "value"), mode, dynamic).partitionBy(*parts).text(root)


def _text(c: F.Column, kind: str) -> F.Column:
    """CSV text of one value: two decimals for doubles, ISO dates, plain integers, null empty."""
    if kind == "double":
        t = fmt2(c)
    elif kind == "date":
        t = F.date_format(c, "yyyy-MM-dd")
    else:
        t = c.cast("string")
    return F.coalesce(t, F.lit(""))


# History columns that stay integers (precipitation extremes / totals, counts, keys).
_INT_HISTORY = {"YEAR", "MONTH", "PRCP_MIN", "PRCP_MAX", "PRCP_SUM"} | {c for c in HISTORY_COLUMNS if c.endswith("_COUNT")}


def _kind_of(name: str, kind: str) -> str:
    if name == "PERIOD_START":
        return "date"
    if kind == "history":
        return "int" if name in _INT_HISTORY else "double"
    return "int" if name in ("DAY", "MONTH", "DAY_OF_MONTH") else "double"


def month_level_lines(raw: DataFrame, history_label: str = "monthly-history",
                      monthly_label: str = "monthly") -> DataFrame:
    """History and monthly-climatology lines from ONE pass over ``month_level_raw``.

    Each (ID, YEAR, MONTH) row yields its history line; the first year of each
    (ID, MONTH) also yields that month's climatology line, whose values are
    window averages / extremes over the (ID, MONTH) rows.  On input clustered
    by (ID, MONTH) there is no shuffle, and the month-level ranking is computed
    once instead of once per output.
    """
    from ..operators.climatology import history_values, monthly_values_over

    by_month = Window.partitionBy("ID", "MONTH").orderBy("YEAR")
    whole_month = by_month.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hist = history_values()
    mon = monthly_values_over(whole_month)
    hist_line = F.concat_ws(",", *[_text(hist[c], _kind_of(c, "history")) for c in HISTORY_COLUMNS])
    mon_line = F.concat_ws(",", *[_text(mon[c], _kind_of(c, "monthly")) for c in MONTHLY_COLUMNS])
    first_year = F.row_number().over(by_month) == 1
    both = raw.select("ID", F.array(
        F.struct(F.lit(history_label).alias("KIND"), (F.col("YEAR").cast("long") * 100 + F.col("MONTH")).alias("_ORD"),
                 F.lit(",".join(HISTORY_COLUMNS)).alias("_HEAD"), hist_line.alias("value")),
        F.struct(F.lit(monthly_label).alias("KIND"), F.col("MONTH").cast("long").alias("_ORD"),
                 F.lit(",".join(MONTHLY_COLUMNS)).alias("_HEAD"), F.when(first_year, mon_line).alias("value")),
    ).alias("_L"))
    out = both.select("ID", F.explode("_L").alias("_l")).where(F.col("_l.value").isNotNull())
    return out.select(F.col("_l.KIND").alias("KIND"), path_prefix("ID").alias("PFX"), "ID",
                      F.col("_l._ORD").alias("_ORD"), F.col("_l._HEAD").alias("_HEAD"), F.col("_l.value").alias("value"))
