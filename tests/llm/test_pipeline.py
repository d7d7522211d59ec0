from __future__ import annotations

import corpus_pipeline
import duckdb
import pytest

from stationclim.llm import decontaminate, near_dup, queries
from stationclim.llm.common import table

from .conftest import SF

ORACLES = queries.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == columns and 0 < len(rows) <= before, name
        before = len(rows)
    found = near_dup.near_duplicates(docs)
    assert found.select("class_id").distinct().count() == before
    assert not decontaminate.digest(decontaminate.hits(docs, table(spark, SF, "benchmark"))).where("contaminated").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
