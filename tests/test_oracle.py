"""Every registered query against its DuckDB oracle at sf0.001 (the correctness gate)."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as se
from conftest import SF_SMALL
from stationclim.plans import registry

ORACLES = se.oracle_sql()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) <= set(se.oracle_sql()) <= set(se.queries())


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["ID", "MONTH"]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLES[name])
    o_cols, o_rows = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert _rows(s_cols, s_rows) == _rows(o_cols, o_rows)
