"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is
described by shares of character classes, word statistics and hashed words,
and encoded by a small layer; gated attention weighs the passages, and a
logistic unit scores the weighted representation.  Labels belong to
documents, never to passages; the attention finds the passages that decide.

The network is fitted in numpy on the driver, on at most ``MAX_TRAIN``
labelled documents in the order of a hash of their id, and at most
``MAX_PASSAGES`` passages of them (documented bounds: about 40 MB of features
reach the driver, however long the texts are or however often an id occurs).
Documents are whole or left out; one with more than a fiftieth of the passages
is not fitted on.  The model is a few kB and is shipped with the task; every
whole text is scored in one pass without a shuffle.

Defined results: null, empty and wordless texts are one passage of zeros;
documents without a label, or a label without a document, are not trained on,
nor are null labels; an id that occurs twice gives two examples; without
labels, or with one class only, every score is the share of class 1 (0.5
without labels); an empty table gives no rows; ``keep_good`` keeps all
columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import append_columns, crc_mod, materialise, slices

PASSAGE = 64       # words
BUCKETS = 32       # hashed words
MAX_TRAIN = 6_000  # labelled documents that the network is fitted on
MAX_PASSAGES = 200_000  # passages of them, 4 x N_FEATURES bytes each
CUT = 0.7
HELD_MODULUS, HELD_REMAINDER = 4, 2

HIDDEN, GATE, STEPS, RATE, DECAY, SEED = 16, 8, 250, 0.03, 1e-4, 7

_CLASSES = [  # bytes whose share is a feature
    range(ord("A"), ord("Z") + 1), b"#*$%&<>", b"|", b"!", b"0123456789", b".", b",;:", range(0x80, 0x100)]
N_FEATURES = len(_CLASSES) + 6 + BUCKETS


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, document of each), in order; a text without words is one row of zeros."""
    n = len(texts)
    data, off = tv.text_bytes(texts)
    m, s, e, row = tv.split_words(data, off, tv.space_table())
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(row.size) - first[row]
    begin = np.flatnonzero(place % PASSAGE == 0)
    empty = np.flatnonzero(count == 0)
    out = np.zeros((begin.size, N_FEATURES), np.float32)
    if begin.size:
        end = np.append(begin[1:], row.size)
        words = (end - begin).astype(np.float64)
        size = (e - s).astype(np.float64)
        total = np.add.reduceat(size, begin)
        for j, group in enumerate(_CLASSES):
            is_in = np.zeros(256, np.int32)
            is_in[list(group)] = 1
            sums = np.concatenate([[0], np.cumsum(is_in[data])])
            out[:, j] = (sums[e[end - 1]] - sums[s[begin]]) / total
        h = tv.hash_words(m, s, e)
        where = np.repeat(np.arange(begin.size), end - begin)
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (where[1:] == where[:-1])])
        _, part, _ = tv.multiset(h, where)
        j = len(_CLASSES)
        out[:, j] = np.log1p(words)
        out[:, j + 1] = np.log(total / words)
        out[:, j + 2] = np.sqrt(np.maximum(np.add.reduceat(size * size, begin) / words - (total / words) ** 2, 0.0))
        out[:, j + 3] = np.add.reduceat(again.astype(np.float64), begin) / words
        out[:, j + 4] = np.bincount(part, minlength=begin.size) / words
        out[:, j + 5] = np.add.reduceat((size == 1).astype(np.float64), begin) / words
        bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
        out[:, j + 6:] = (np.bincount(where * BUCKETS + bucket, minlength=begin.size * BUCKETS).reshape(-1, BUCKETS) / words[:, None])
    doc = np.concatenate([row[begin], empty])
    order = np.argsort(doc, kind="stable")
    return np.concatenate([out, np.zeros((empty.size, N_FEATURES), np.float32)])[order], doc[order]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, x: np.ndarray, doc: np.ndarray):
    """``doc``: dense document numbers, ascending."""
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    hid = np.tanh(x @ p["W"] + p["b"])
    tv_, su = np.tanh(hid @ p["V"]), _sigmoid(hid @ p["U"])
    gate = tv_ * su
    s = gate @ p["w"]
    ex = np.exp(s - np.maximum.reduceat(s, at)[doc])
    a = ex / np.add.reduceat(ex, at)[doc]
    z = np.add.reduceat(a[:, None] * hid, at)
    return at, hid, tv_, su, gate, a, z, _sigmoid(z @ p["c"] + p["c0"])


def gradients(p: dict, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean logistic loss."""
    at, hid, tv_, su, gate, a, z, prob = _forward(p, x, doc)
    d = (prob - y) / y.size
    dz = d[:, None] * p["c"]
    of = dz[doc]
    da = np.einsum("ij,ij->i", hid, of)
    ds = a * (da - np.add.reduceat(a * da, at)[doc])
    dg = ds[:, None] * p["w"]
    dt, du = dg * su * (1 - tv_ * tv_), dg * tv_ * su * (1 - su)
    dh = (a[:, None] * of + dt @ p["V"].T + du @ p["U"].T) * (1 - hid * hid)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": hid.T @ dt, "U": hid.T @ du, "w": gate.T @ ds,
            "c": z.T @ d, "c0": np.array([d.sum()])}


def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict:
    """Adam on the mean logistic loss over all documents at once."""
    rng = np.random.default_rng(SEED)
    p = {"W": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
         "w": rng.normal(0, GATE ** -0.5, GATE), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "c0": np.zeros(1)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        grad = gradients(p, x, doc, y)
        for k, g in grad.items():
            g = g + DECAY * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return p


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_train: int = MAX_TRAIN,
          max_passages: int = MAX_PASSAGES) -> dict:
    """Model from ``labels`` (doc_id, quality) that are ``usable`` (default: not held out)."""
    usable = (crc_mod("doc_id", HELD_MODULUS) != HELD_REMAINDER) if usable is None else usable
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(usable)
              .select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id", "y").limit(max_train))
    joined = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", "text")  # chosen: at most max_train rows

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x, doc = passages(part.column(2))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                blobs = [x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(cut), pa.int64()),
                                                  pa.array(blobs, pa.binary())], names=["id", "y", "n", "x"])

    schema = T.StructType([joined.schema["id"], joined.schema["y"], T.StructField("n", T.LongType()), T.StructField("x", T.BinaryType())])
    bags = materialise(joined.mapInArrow(describe, schema), "mil-bags").where(F.col("n") <= max(1, max_passages // 50))
    order = [F.xxhash64("id"), "id", "n", "y", "x"]
    heads = bags.orderBy(*order).select("n").limit(max_train).collect()
    taken = int(np.searchsorted(np.cumsum([r.n for r in heads]), max_passages, "right"))
    rows = sorted(bags.orderBy(*order).limit(taken).collect(), key=lambda r: (r.id, r.y, bytes(r.x))) if taken else []
    y = np.array([r.y for r in rows], float)
    if y.size == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if y.size else 0.5}
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(parts).astype(np.float64)
    doc = np.repeat(np.arange(len(parts)), [len(q) for q in parts])
    mean, std = x.mean(0), x.std(0) + 1e-3
    return {"mean": mean, "std": std, **fit((x - mean) / std, doc, y)}


def _scorer(model: dict):
    def make(texts: pa.Array) -> list[pa.Array]:
        if "constant" in model or not len(texts):
            return [pa.array([model.get("constant", 0.5)] * len(texts), pa.float64())]
        x, doc = passages(texts)
        return [pa.array(_forward(model, (x - model["mean"]) / model["std"], doc)[-1])]

    return make


def score(docs: DataFrame, model: dict) -> tuple[DataFrame, str]:
    """``docs`` with the score appended, and the score column's name."""
    out, names = append_columns(docs, F.col("text"), [T.StructField("score", T.DoubleType())], _scorer(model))
    return out, names[0]


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    out, name = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", HELD_MODULUS) == HELD_REMAINDER).alias("held_out"),
                      F.col(name).alias("score"), (F.col(name) >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of ``docs`` that score at least ``CUT``; the model is fitted on the labelled part of ``corpus``."""
    out, name = score(docs, train(corpus, labels))
    return out.where(F.col(name) >= CUT).select(*docs.columns)
