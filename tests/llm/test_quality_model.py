"""The attention network against a passage-by-passage loop, its gradient, and the bounds of the fitted sample."""

from __future__ import annotations

import math

import numpy as np
import pytest

from stationclim.llm import quality_model as Q
from stationclim.llm.common import table

from .conftest import SF


def parameters(rng, n_features):
    shapes = {"W": (n_features, Q.HIDDEN), "b": (Q.HIDDEN,), "V": (Q.HIDDEN, Q.GATE), "U": (Q.HIDDEN, Q.GATE), "w": (Q.GATE,), "c": (Q.HIDDEN,),
              "c0": (1,)}
    return {k: rng.normal(0, 0.5, s) for k, s in shapes.items()}


def naive(p, bag):
    hid = [np.tanh(x @ p["W"] + p["b"]) for x in bag]
    sig = lambda v: 1 / (1 + np.exp(-v))
    e = [math.exp(float((np.tanh(h @ p["V"]) * sig(h @ p["U"])) @ p["w"])) for h in hid]
    z = sum(h * (q / sum(e)) for h, q in zip(hid, e))
    return float(sig(z @ p["c"] + p["c0"][0]))


def test_forward_and_gradient():
    rng = np.random.default_rng(4)
    sizes = [1, 4, 2, 7, 1]
    p, x = parameters(rng, 5), rng.normal(size=(sum(sizes), 5))
    doc, y = np.repeat(np.arange(len(sizes)), sizes), np.array([1.0, 0, 1, 1, 0])
    cut = np.cumsum([0, *sizes])
    want = [naive(p, x[a:b]) for a, b in zip(cut, cut[1:])]
    assert np.allclose(Q._forward(p, x, doc)[-1], want, atol=1e-12)

    def loss(q):
        s = Q._forward(q, x, doc)[-1]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k, g in Q.gradients(p, x, doc, y).items():
        for j in range(g.size):
            q = {n: v.copy() for n, v in p.items()}
            q[k].flat[j] += 1e-6
            up = loss(q)
            q[k].flat[j] -= 2e-6
            assert g.flat[j] == pytest.approx((up - loss(q)) / 2e-6, abs=1e-7), (k, j)


def test_scores_equal_the_naive_network(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = Q.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    import pyarrow as pa

    for r in Q.quality_scores(docs, labels).limit(30).collect():
        x, _ = Q.passages(pa.array([texts[r.doc_id]], pa.string()))
        assert r.score == pytest.approx(naive(model, (x - model["mean"]) / model["std"]), abs=1e-9)


def test_the_fitted_sample_is_bounded(spark, monkeypatch):
    """An id that occurs in many rows, and very long texts, bring no more than the stated passages."""
    rows = [(1, "word " * 200)] * 300 + [(2, "w " * 60_000)] + [(k, f"text {k} " * 40) for k in range(3, 90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 90)], "doc_id bigint, quality int")
    seen = {}

    def record(x, doc, y):
        seen.update(passages=len(x), documents=len(y))
        return {}

    monkeypatch.setattr(Q, "fit", record)
    from pyspark.sql import functions as F

    Q.train(docs, labels, F.lit(True), max_passages=200)
    assert 0 < seen["passages"] <= 200
    Q.train(docs, labels, F.lit(True), max_train=10)
    assert seen["documents"] <= 10
    assert Q.train(docs, labels, F.lit(True), max_passages=0) == {"constant": 0.5}
