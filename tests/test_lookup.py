"""``lookup_station`` looks up every observed station, not a fixed few."""

from __future__ import annotations

import datetime as dt

import duckdb
import duckdb_oracle

from stationclim.plans import registry


def test_every_observed_station_is_found(spark, tmp_path):
    """Nulls in the keys, a repeated station line and a station without observations."""
    day = dt.date(2000, 1, 2)
    tables = {
        "nation": ("n_nationkey bigint, n_name string", [(i, f"N{i}") for i in range(6)] + [(4, "N4")]),
        "region": ("r_regionkey bigint", [(0,), (1,)]),
        "supplier": ("s_suppkey bigint, s_nationkey bigint", [(1, 0), (2, 4), (3, 5), (4, 4), (5, None), (6, 7), (None, 1)]),
        "lineitem": ("l_suppkey bigint, l_shipdate date, l_returnflag string, l_quantity bigint, l_linenumber int",
                     [(k, day, "A", 5, n) for k in (1, 2, 3, 4, 5, 6, None) for n in (1, 3)]),
    }
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    found = registry.QUERIES["lookup_station"](spark, str(tmp_path))
    assert sorted(r.ID for r in found.collect()) == ["CHM00000000", "GMM00000004", "GMM00000004", "UKE00000005"]
    expected = con.sql(duckdb_oracle.build()["lookup_station"])
    key = lambda t: sorted(map(str, t))
    assert key(tuple(r) for r in found.select(*expected.columns).collect()) == key(expected.fetchall())
