"""Station-side operators: selection, MISSING flag, GeoJSON features, map views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import path_prefix, starts_with_any
from ..plans.sizing import MAX_BROADCAST_ROWS, broadcast_if_small
from ..schema import STATION_PREFIXES

PROPERTY_COLUMNS = ("ID", "NAME", "STATE", "ELEVATION", "GSN_FLAG", "HCN_CRN_FLAG", "WMO_ID", "MISSING")


def filter_station_prefix(df: DataFrame, prefixes: Sequence[str] = STATION_PREFIXES, id_col: str = "ID") -> DataFrame:
    """Keep IDs starting with any prefix (becomes pushed StringStartsWith filters)."""
    return df.where(starts_with_any(id_col, prefixes))


def filter_station(df: DataFrame, stations, id_col: str = "ID",
                   max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Keep one station, a list of stations, or the IDs of a station DataFrame.

    A DataFrame of IDs becomes a LEFT SEMI join.  The ID side is broadcast
    only after its row count is checked against ``MAX_BROADCAST_ROWS``;
    beyond that bound Spark plans a shuffle join instead.
    """
    if isinstance(stations, DataFrame):
        ids = stations.select(F.col(id_col).alias("_SID"))  # a semi join needs no distinct
        ids, _ = broadcast_if_small(ids, max_broadcast_rows)
        return df.join(ids, df[id_col] == ids["_SID"], "left_semi")
    if isinstance(stations, str):
        return df.where(F.col(id_col) == stations)
    return df.where(F.col(id_col).isin(*list(stations)))


def with_path_prefix(df: DataFrame, id_col: str = "ID", out: str = "PFX") -> DataFrame:
    return df.withColumn(out, path_prefix(id_col))


def lookup_station(stations: DataFrame, ids, id_col: str = "ID") -> DataFrame:
    """Station records for one ID, a list of IDs, or the IDs of a DataFrame (unknown IDs give no row).

    One ID or a list is a plain filter that reaches the scan of the list.
    """
    return filter_station(stations, ids, id_col)


def flag_missing(stations: DataFrame, daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """``MISSING`` = the station lacks a daily output or a monthly output."""
    d = daily.select("ID").distinct().withColumn("_HAS_D", F.lit(True))
    m = monthly.select("ID").distinct().withColumn("_HAS_M", F.lit(True))
    j = stations.join(d, "ID", "left").join(m, "ID", "left")
    return j.withColumn("MISSING", F.col("_HAS_D").isNull() | F.col("_HAS_M").isNull()).drop("_HAS_D", "_HAS_M")


def flag_missing_from_presence(stations: DataFrame, presence: DataFrame) -> DataFrame:
    """``flag_missing`` from ``climatology.output_presence`` (ID, HAS_DAILY, HAS_MONTHLY)."""
    p = presence.select("ID", "HAS_DAILY", "HAS_MONTHLY")
    j = stations.join(p, "ID", "left")
    has_both = F.coalesce(F.col("HAS_DAILY"), F.lit(False)) & F.coalesce(F.col("HAS_MONTHLY"), F.lit(False))
    return j.withColumn("MISSING", ~has_both).drop("HAS_DAILY", "HAS_MONTHLY")


def feature_struct() -> F.Column:
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"),
            F.array(F.col("LONGITUDE"), F.col("LATITUDE")).alias("coordinates"),
        ).alias("geometry"),
        F.struct(*[F.col(c) for c in PROPERTY_COLUMNS]).alias("properties"),
    )


def geojson_features(flagged: DataFrame) -> DataFrame:
    """(ID, FEATURE) with one GeoJSON Point feature per station; nulls are kept."""
    return flagged.select("ID", F.to_json(feature_struct(), {"ignoreNullFields": "false"}).alias("FEATURE"))


FEATURE_SCHEMA = (
    "type string, geometry struct<type: string, coordinates: array<double>>, "
    "properties struct<ID: string, NAME: string, STATE: string, ELEVATION: double, GSN_FLAG: string, "
    "HCN_CRN_FLAG: string, WMO_ID: string, MISSING: boolean>"
)


def parse_features(features: DataFrame, col: str = "FEATURE") -> DataFrame:
    """Inverse of ``geojson_features``: flat columns from feature JSON text."""
    f = F.from_json(F.col(col), FEATURE_SCHEMA)
    return features.select(f.alias("_f")).select(
        F.col("_f.type").alias("FEATURE_TYPE"),
        F.col("_f.geometry.type").alias("GEOMETRY_TYPE"),
        F.col("_f.geometry.coordinates")[0].alias("LONGITUDE"),
        F.col("_f.geometry.coordinates")[1].alias("LATITUDE"),
        *[F.col(f"_f.properties.{c}").alias(c) for c in PROPERTY_COLUMNS],
    )


def filter_bounds(flagged: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Stations inside the (inclusive) lat/lon rectangle that are not MISSING."""
    return flagged.where(
        F.col("LATITUDE").between(south, north) & F.col("LONGITUDE").between(west, east) & ~F.col("MISSING")
    )


def heat_points(flagged: DataFrame) -> DataFrame:
    """Heat-map input: (LATITUDE, LONGITUDE, WEIGHT = 1) per non-MISSING station."""
    return flagged.where(~F.col("MISSING")).select("ID", "LATITUDE", "LONGITUDE", F.lit(1).alias("WEIGHT"))
