from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) pairs -> documents, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, None if i is None else "en", None, 0, "x", 1.0, True) for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", score string, weight double, kept boolean")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, wordless, repeated, short and very long texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = [rng.choice(words) for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    return [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ---"), (5, "one two"), (6, "one two"), (6, "one two"), (None, "Null id here"),
            (7, long), (8, " ".join(base)), (9, " ".join(near)), (10, " ".join(base).upper()), (11, "ünïcödé wörds 日本語 ☃ <|im_end|>")]
