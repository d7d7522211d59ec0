"""Language identification: features against a naive version, gradients, calibration, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stationclim.llm import language_id as L
from stationclim.llm import queries
from stationclim.llm.common import table
from stationclim.llm.textvec import mix

from .conftest import SF


def naive_subwords(text):
    out, word = Counter(), []
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            word.append(ord(c))
            continue
        marked = [0, *word, 0]
        for g in range(1, L.MAX_GRAM + 1):
            for a in range(len(marked) - g + 1) if word else ():
                gram = marked[a:a + g]
                if any(gram):
                    h = np.zeros(1, np.uint64)
                    for q in gram:
                        h = mix(h * np.uint64(0x100000001B3) + np.uint64(q) + np.uint64(1))
                    out[int(h[0] >> np.uint64(40)) % L.BUCKETS] += 1
        word = []
    return out


TEXTS = ["ab  c1d", None, "..", "é!", "", "Straße über Äpfel", "x", "\n\na\nb", "日本語 text", "a" * 40, "-a", "A-"]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1], [None], ["", ""], ["q"]])
def test_subwords(texts):
    bucket, row = L.subwords(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert Counter(bucket[row == k].tolist()) == naive_subwords(t)


def test_training_lowers_the_loss_and_a_step_follows_the_gradient(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(L, "BUCKETS", 40)
    bags = [("ab"[k % 2], np.sort(rng.choice(20, 6, replace=False)) + 20 * (k % 2), np.ones(6, np.float32)) for k in range(60)]
    bags += [(lang, np.arange(40), np.ones(40, np.float32)) for lang in "ab"]

    def loss(emb, out, bias):
        p = L._softmax(L._dense(bags, range(len(bags))) @ emb @ out + bias)
        return -np.log(p[np.arange(len(bags)), [int(b[0] == "b") for b in bags]].astype(float)).mean()

    start, end = loss(*L.train(bags, ["a", "b"], range(len(bags)), epochs=0)), loss(*L.train(bags, ["a", "b"], range(len(bags))))
    assert end < 0.5 * start
    # One full batch with a tiny rate moves every parameter along the numerical gradient.
    monkeypatch.setattr(L, "BATCH", len(bags))
    monkeypatch.setattr(L, "RATE", 1e-3)
    base = L.train(bags, ["a", "b"], range(len(bags)), epochs=0)
    moved = L.train(bags, ["a", "b"], range(len(bags)), epochs=1)
    for k in (1, 2):
        step = (moved[k] - base[k]).astype(float) / -1e-3
        flat = base[k].reshape(-1)
        for j in range(0, flat.size, max(1, flat.size // 5)):
            save = flat[j]
            flat[j] = save + 1e-2
            up = loss(*base)
            flat[j] = save - 1e-2
            down = loss(*base)
            flat[j] = save
            assert step.reshape(-1)[j] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_temperature_is_the_least_loss():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(500, 3)) * 4
    y = np.array([rng.choice(3, p=q) for q in L._softmax(0.6 * z)])
    loss = lambda b: -np.log(L._softmax(b * z)[np.arange(500), y]).mean()
    b = L.temperature(z, y)
    assert 0.4 < b < 0.8 and all(loss(b) <= loss(b * f) for f in (0.9, 0.99, 1.01, 1.1))


def test_held_out_accuracy_and_scores_of_the_naive_model(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = queries.QUERIES["op11_subword_language"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.95 * len(held)
    assert sum(r.accepted for r in got) >= 0.9 * len(got)
    model = L.fit(docs)
    for r in got[:25]:
        bag = naive_subwords(truth[r.doc_id][1])
        z = sum(model["table"][b] * c for b, c in bag.items()) / sum(bag.values()) + model["bias"]
        p = L._softmax(model["beta"] * z[None])[0]
        assert r.lang_pred == model["langs"][int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-9)


def test_predictions_do_not_depend_on_the_held_out_rows_or_labels(spark):
    docs = table(spark, SF, "documents")
    from pyspark.sql import functions as F

    odd = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit("xx")).otherwise(F.col("lang"))
    a = {r.doc_id: r.lang_pred for r in L.languages(docs).collect()}
    b = {r.doc_id: r.lang_pred for r in L.languages(docs.withColumn("lang", odd).withColumn("source", F.lit("zz"))).collect()}
    assert a == b and "xx" not in a.values()


def test_odd_rows(spark, docs_of, odd_rows):
    words = {"en": "the and that with have this from they".split(), "fr": "le que dans pour avec être mais nous".split()}
    rng = random.Random(4)
    known = [(1000 + k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for k, lang in enumerate(["en", "fr"] * 60)]
    docs = docs_of(odd_rows).withColumnRenamed("kept", "lang_pred").select("doc_id", "text", "score", "lang_pred")
    from pyspark.sql import functions as F

    labelled = spark.createDataFrame(known, "doc_id bigint, text string, lang string")
    every = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(labelled, allowMissingColumns=True)
    got = L.languages(every).collect()
    assert len(got) == len(odd_rows) + len(known)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3, 4):
        assert [(r.lang_pred, r.score, r.accepted) for r in by[i]] == [("und", 0.0, False)]
    assert len(by[6]) == 2 and len({(r.lang_pred, r.score) for r in by[6]}) == 1
    assert all(r.lang_pred in ("en", "fr") and 0 < r.score <= 1 for i in (None, 5, 7, 8, 11) for r in by[i])
    assert all(by[i][0].lang_pred == lang for i, _, lang in known)


@pytest.mark.parametrize("langs,want", [([], "und"), (["en"] * 9, "en")])
def test_too_few_languages(spark, langs, want):
    rows = [(k, f"text number {k}", lang) for k, lang in enumerate(langs)] + [(90, "some words", None), (91, "", None)]
    got = {r.doc_id: r for r in L.languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[90].lang_pred == want and got[91].lang_pred == "und" and got[90].score == (want == "en")


def test_sample_is_bounded_and_balanced(spark):
    rows = [(k, f"word{k} common", "big" if k % 20 else "small") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    bags = L.sample(docs, max_train=200)
    count = Counter(b[0] for b in bags)
    assert sum(count.values()) <= 200 and min(count.values()) > 60
    few = L.sample(docs, max_train=200, max_entries=900)
    assert sum(len(b[1]) for b in few) <= 900 and len(few) >= 5
    assert [b[0] for b in few] == [b[0] for b in bags[:len(few)]]


def test_empty_table(spark):
    assert L.languages(table(spark, SF, "documents").limit(0)).count() == 0
