"""Operators and the pipeline leave no scratch folder but those that their result reads."""

from __future__ import annotations

import glob
import os

import corpus_pipeline
import pytest

from stationclim.llm import queries

from .conftest import SF


def folders(spark):
    return set(glob.glob(os.path.join(spark.sparkContext.getCheckpointDir().replace("file:", ""), "stationclim-scratch", "*")))


@pytest.mark.parametrize("name,most", [("op1_bag_minhash", 3), ("op3_label_propagation", 3), ("op8_robust_outliers", 2), ("op13_feast_whitening", 0)])
def test_queries(spark, name, most):
    before = folders(spark)
    out = queries.QUERIES[name](spark, SF)
    left = folders(spark) - before
    assert len(left) <= most, left
    rows = out.collect()  # what is left is all that the result needs
    assert rows and len(folders(spark) - before) == len(left)


def test_pipeline(spark):
    before = folders(spark)
    out = corpus_pipeline.run(spark, SF)
    left = folders(spark) - before
    assert len(left) <= 2, left  # the packed blocks; no stage's documents
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert out.columns[:3] == ["block", "bin", "slot"] and 0 < len(ids) < 200
    assert all(r.n_tokens <= 4096 for r in rows) and len(folders(spark) - before) == len(left)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, docs_of, odd_rows, tmp_path, kind):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns; and no rows at all."""
    from pyspark.sql import functions as F

    from stationclim.llm.common import table

    docs = table(spark, SF, "documents").unionByName(docs_of(odd_rows), allowMissingColumns=True)
    docs = docs.unionByName(docs.where("doc_id = 3")).withColumn("source", F.when(F.col("doc_id") % 7 != 0, F.col("source")))
    if kind == "empty":
        docs = docs.limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("benchmark", "labels"):
        table(spark, SF, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert rows == []
        return
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert rows and {r.doc_id for r in rows} <= {i for i, _ in texts}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, str(tmp_path)).columns == columns, name
