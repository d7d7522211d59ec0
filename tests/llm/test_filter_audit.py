"""The filter audit against a plain simulation of all 120 orders."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from stationclim.llm import filter_audit as A

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, smaller):
    words = SPACE.findall(text)
    return {f for f, bad in zip("ABCDE", (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        bool(re.search(r"[#$%&*|]", text)), text in smaller)) if bad}


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(s or "", fails(t or "", {u or "" for j, u, _ in docs if None not in (i, j) and j < i}), i in good, i in toxic)
            for i, t, s in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone),
                                                   sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for (p, o, s), v in out.items():
            if p == part:
                v[6] = shapley[v[6]]
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    long = [" ".join(word() for _ in range(rng.choice([199, 200, 260]))) for _ in range(12)]
    odd = ["", None, " \n\t", "one", "#", "A" * 30, "é" * 49 + "A", "é" * 50 + "A", "\x1c".join(long[0].split()), long[1] + " |",
           " ".join(["same"] * 300), " ".join(["X y"] * 200), " ".join(word() for _ in range(20_000))]
    docs = [(k, rng.choice(long + odd), rng.choice(["s1", "s1", "s2", "", None, "s'3"])) for k in range(120)]
    docs += [(5, long[2], "s1"), (5, long[2], "s2"), (None, long[2], "s1"), (None, None, None), (-1, long[3], "only")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, 1, 1), (9999, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, source string, bits int, part string"),
            spark.createDataFrame([(*q, "x") for q in labels], "doc_id bigint, quality int, toxic int, digest string"))


def test_audit_against_simulation(spark, monkeypatch):
    docs, labels = corpus()
    d, q = frames(spark, docs, labels)
    want = brute(docs, labels)
    for hot_share in (A.HOT_SHARE, 3):  # every repeated text hot; only the most frequent ones hot
        monkeypatch.setattr(A, "HOT_SHARE", hot_share)
        got = A.audit(d.repartition(4), q).collect()
        assert len(got) == len(want) == 600 * 5
        for r in got:
            assert [r[c] for c in COLUMNS] == want[r.part, r.filter_order, r.step], r


def test_posting_lists_are_sorted_and_name_their_documents(spark):
    docs, labels = corpus()
    d, q = frames(spark, docs, labels)
    rows = A.with_labels(A.with_copies(A.failures(d.repartition(3))), q)
    lists = A.posting_lists(rows, range_rows=16).collect()
    assert sum(p.n_rows for p in lists) == len(docs) and max(p.n_rows for p in lists) <= 16
    first = [p.first_id for p in lists]
    assert len(set(first)) == len(first)
    named = Counter()
    for p in lists:
        assert len(p.doc_ids) == p.n_rows
        for f in A.LISTS:
            ids = p[f]
            assert ids == sorted(set(ids)) and all(p.first_id <= i < p.first_id + p.n_rows for i in ids)
            if f == "A":
                named.update(p.doc_ids[i - p.first_id] for i in ids)
    assert named == Counter(i for i, t, _ in docs if len(SPACE.findall(t or "")) < 200)


def test_differences_by_galloping():
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.choice(1000, size, replace=False)) for size in (0, 3, 1000, 250, 40, 500, 30)]
    border = np.array([0, 1, 1, 400, 1000])
    got = A.difference_sizes(lists, border)
    sets = [set(x.tolist()) for x in lists]
    for f, p in A.PAIRS:
        left = sets[f].difference(*[sets[j] for j in range(5) if p >> j & 1])
        for j, some in enumerate((left, left & sets[5], left & sets[6])):
            want = [sum(a <= i < b for i in some) for a, b in zip(border, border[1:])]
            assert got[3 * A._AT[f, p] + j].tolist() == want


def test_empty_tables(spark):
    d, q = frames(spark, *corpus())
    assert A.audit(d.limit(0), q).count() == 0
    got = A.audit(d.where("doc_id = 3"), q.limit(0)).collect()
    assert len(got) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in got)
