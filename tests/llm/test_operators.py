"""Every operator on odd rows, empty tables and against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stationclim.llm import (chat, decontaminate, language_model, licences, near_dup, packing, quality_model, quality_rules,
                             sharding, textvec, token_counts)
from stationclim.llm.common import fresh, slices, table

from .conftest import SF

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ helpers

def test_fresh_ignores_case():
    assert fresh("score", ["Score", "_score"]) == "__score"


def test_slices_keep_every_row():
    b = pa.RecordBatch.from_pydict({"i": list(range(50)), "t": ["x" * (i * 40) if i % 7 else None for i in range(50)]})
    got = [i for s in slices(b, "t", max_bytes=500, max_rows=4) for i in s.column(0).to_pylist()]
    assert got == list(range(50))


def test_vector_words_match_regex(odd_rows):
    texts = [t or "" for _, t in odd_rows]
    data, off = textvec.text_bytes(pa.array([t for _, t in odd_rows]))
    for tab, pattern in ((textvec.space_table(), rb"[^\x20\x09-\x0D]+"),
                         (textvec.alnum_table(), rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        m, s, e, row = textvec.split_words(data, off, tab)
        low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))) if pattern.startswith(rb"[^\x00") else None
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, t.encode().translate(low) if low else t.encode())]
        assert [(int(r), m[a:b].tobytes()) for a, b, r in zip(s, e, row)] == want


# ------------------------------------------------------------------ 1 near-duplicates

def shingle_counts(text):
    w = decontaminate.words_of(text)
    if not w:
        return Counter()
    return Counter([tuple(w)]) if len(w) < 5 else Counter(zip(*(w[i:] for i in range(5))))


def brute_classes(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_counts(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            union = sum(sets[i].values()) + sum(sets[j].values()) - both
            if (rows[i][1] or "") == (rows[j][1] or "") or (union and both >= threshold * union - 1e-9):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(str(rows[i][0]))
    return sorted(sorted(g) for g in groups.values())


def classes_of(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.class_id].append(str(r.doc_id))
    return sorted(sorted(g) for g in groups.values())


def test_near_duplicates_odd_rows(docs_of, odd_rows):
    assert classes_of(near_dup.near_duplicates(docs_of(odd_rows))) == brute_classes(odd_rows)


def test_near_duplicates_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert classes_of(near_dup.near_duplicates(docs)) == brute_classes(rows)


def test_dense_group_below_the_threshold(docs_of):
    """Edited copies whose mutual similarity straddles the threshold: hubs alone do not find all links."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((i, " ".join(t)))
    assert classes_of(near_dup.near_duplicates(docs_of(rows))) == brute_classes(rows)


def test_signature_estimates_weighted_jaccard():
    rng = random.Random(1)
    a = [rng.choice("abcdefghijklmnop") for _ in range(300)]
    b = a[:200] + [rng.choice("abcdefghijklmnop") for _ in range(100)]
    texts = pa.array([" ".join(a), " ".join(b)])
    elem, row, count = near_dup.text_multisets(texts, 1)
    sig = near_dup.signatures(elem, row, count, 2, 4096)
    ca, cb = Counter(a), Counter(b)
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    assert np.isfinite(sig).all() and abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_block_links_equal_pairwise_overlap():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randint(0, 30))) for _ in range(25)]
    got = near_dup._block_links(pa.array(texts), 5, 0.3)
    for i in range(25):
        for j in range(25):
            x, y = shingle_counts(texts[i]), shingle_counts(texts[j])
            both = sum((x & y).values())
            assert got[i, j] == (both >= 0.3 * (sum(x.values()) + sum(y.values()) - both) - 1e-9)


def test_keep_one(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(brute_classes(odd_rows)) and {1, 5, 8} <= set(ids) and not {2, 6, 9, 10} & set(ids)


# ------------------------------------------------------------------ 2 classifier

def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_model.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = got.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_classifier_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(5, 1, 0), (7, None, 0), (None, 0, 0), (8, 0, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(odd_rows)
    got = quality_model.quality_scores(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    none = quality_model.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.keep_good(docs, docs, labels).columns == docs.columns


# ------------------------------------------------------------------ 3 sharding

def shards_ok(rows, n):
    counts = Counter(r.shard for r in rows)
    assert max(counts.get(s, 0) for s in range(n)) - min(counts.get(s, 0) for s in range(n)) <= 1
    for s, k in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(k))


def test_sharding(spark):
    docs = table(spark, SF, "documents")
    rows = sharding.shards(docs, 5).collect()
    shards_ok(rows, 5)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" for r in rows)
    where = defaultdict(set)
    for r in rows:
        where[text[r.doc_id]].add(r.shard)
    assert sum(len(v) - 1 for v in where.values()) <= 1  # at most the group at the edge is cut


def test_sharding_hot_group_and_odd_rows(docs_of, odd_rows):
    rows = sharding.shards(docs_of(odd_rows + [(100 + i, "the same text") for i in range(40)]), 4).collect()
    assert len(rows) == len(odd_rows) + 40
    shards_ok(rows, 4)


# ------------------------------------------------------------------ 4 decontamination

def test_decontamination_odd_rows(spark, docs_of, odd_rows):
    long = dict(odd_rows)[7].split()
    bench = spark.createDataFrame(
        [(1, " ".join(long[500:530])), (2, "ONE, two"), (2, "one two"), (None, "null ID here"), (4, None), (5, ""), (6, "not to be found")],
        "item_id bigint, text string")
    docs = docs_of(odd_rows)
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.hits(docs, bench)).collect()}
    split = {r.doc_id: r for r in decontaminate.digest(decontaminate.hits(docs, bench, block_windows=3)).collect()}
    assert got == split
    assert got[7].n_hit == 30 and got[7].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[5].n_hit == 2 and got[5].n_items == 1 and got[5].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert got[None].contaminated and got[None].n_items == 0
    assert got[1].n_words == 0 and not got[1].contaminated and not got[8].contaminated
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {1, 2, 3, 4, 8, 9, 10, 11}
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == len(odd_rows)


# ------------------------------------------------------------------ 5 language model

def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in language_model.initial(np.ones(language_model.SUBWORDS + 1)).items()}
    n = language_model.CONTEXT
    ids, scored = rng.integers(0, 1024, (3, n)), rng.random((3, n)) < 0.8
    target = rng.integers(0, 1024, int(scored.sum()))
    g = language_model.gradients(p, ids, scored, target)
    for k, i in (("E", (ids[0, 3], 2)), ("P", (4, 1)), ("Wq", (1, 2)), ("Wk", (2, 3)), ("Wv", (0, 1)), ("W1", (3, 4)),
                 ("M", (target[0] // 32, target[0] % 32, 5)), ("bc", (target[0] // 32,))):
        v = p[k][i]
        p[k][i] = v + 1e-5
        up = -language_model.log_probs(p, ids, scored, target).mean()
        p[k][i] = v - 1e-5
        down = -language_model.log_probs(p, ids, scored, target).mean()
        p[k][i] = v
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-6


def test_windows_score_every_id_once():
    for n in (0, 1, 11, 12, 15, 16, 27, 28, 200):
        text = np.arange(n, dtype=np.uint16).tobytes()
        ids, scored, target, owner = language_model.windows([text, b"", text])
        assert target[owner == 0].tolist() == [*range(n), language_model.END] and (owner == 1).sum() == 1
        assert (target[owner == 2] == target[owner == 0]).all()


def test_lm_base_scores(spark, docs_of, odd_rows):
    got = language_model.lm_scores(docs_of(odd_rows), rates=(0.02,)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: [w.encode().lower() if w.isascii() else w.encode().translate(language_model._LOWER) for w in SPACE_WORD.findall(t or "")]
    c: Counter = Counter()
    for i, t in odd_rows:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in odd_rows:
        w = [*words(t), None]
        want[(str(i), held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5))] += 1
    assert Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


# ------------------------------------------------------------------ 6 licences

def test_licences(spark, docs_of):
    mit = "Copyright (c) 2020 A. Person\n\n" + licences._MIT_BODY.replace("sublicense", "SUBLICENCE").replace(",", " ;")
    rows = [(1, mit), (2, "x\nReleased under the MIT Licence!\nreleased under the mit license\n"), (3, None), (4, ""), (5, mit + " more")]
    for bound in (None, 0):
        known = licences.known_texts(spark)
        got = {r.doc_id: r for r in licences.scan(docs_of(rows), known).collect()}
        assert [got[i].license_id for i in range(1, 6)] == ["MIT", None, None, None, None]
        assert got[2].n_notices == 2 and got[2].notice_ids == "MIT" and got[3].n_notices == 0
    empty = licences.scan(docs_of(rows), licences.known_texts(spark).limit(0)).collect()
    assert len(empty) == 5 and all(r.license_id is None and r.n_notices == 0 for r in empty)


# ------------------------------------------------------------------ 7 token counts

@pytest.mark.parametrize("scores", ["zipf", "file"])
def test_token_counts_equal_the_tokenizer(spark, docs_of, odd_rows, scores):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = token_counts.load_pieces(token_counts.VOCABULARY, scores)
    tok = Tokenizer(models.Unigram(pieces, unknown, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    rows = odd_rows + [(20, "  a  b\n\nc ▁x <0x0A> </s>"), (21, "x" * 5000)] + [
        (r.doc_id + 1000, r.text) for r in table(spark, SF, "documents").collect()]
    want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs_of(rows), scores=scores).collect())
    assert got == want


# ------------------------------------------------------------------ 8 quality rules

def brute_stats(t):
    words = SPACE_WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if SPACE_WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_counts(spark, docs_of, odd_rows):
    rows = odd_rows + [(30, "a b c a b c a b c"), (31, "x y\nx y\n\n \nx y"), (32, "# a * b | c\x1cd e")]
    got = Counter(tuple(r)[:7] for r in quality_rules.robust_outliers(docs_of(rows)).collect())
    want = Counter()
    for i, t in rows:
        s = brute_stats(t)
        want[(i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got == want


def test_quality_outliers(spark):
    """The Spark estimate's verdicts reject labelled junk and keep the rest (sf0.01, held labels only judge)."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    rows = quality_rules.robust_outliers(docs).join(table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    junk, clean = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk) and sum(r.kept for r in clean) >= 0.98 * len(clean)
    kept = quality_rules.keep_inliers(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.robust_outliers(docs).where("kept").count()


def test_mcd_step_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.rint(rng.normal(3, 0.5, (400, quality_rules.DIM)) * quality_rules.UNIT).astype(int)
    x[:60] += 5 * quality_rules.UNIT
    v = spark.createDataFrame([("p", r.tolist()) for r in x], "pool string, x array<int>")
    start = quality_rules._start(v)
    s = start.first()
    assert np.allclose(s.mean, np.median(x, 0), atol=quality_rules.UNIT / 16)
    got = quality_rules._step(v, start).first()
    d = x - np.array(s.mean)
    d2 = np.einsum("ij,jk,ik->i", d, np.array(s.inv).reshape(6, 6), d)
    b = np.floor(np.log1p(d2) * quality_rules.BINS)
    inside = x[np.array([(b < k).sum() < quality_rules.SUPPORT * len(x) for k in b])]
    cov = np.cov(inside.T, bias=True) + np.diag((np.array(quality_rules.FLOOR) * quality_rules.UNIT) ** 2)
    assert np.allclose(got.mean, inside.mean(0)) and np.allclose(np.array(got.inv).reshape(6, 6), np.linalg.inv(cov))


def quality_doc(rng, lines=16, upper=0):
    """An ordinary text: no symbols, no repeated line, hardly a repeated window."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9)))
    return "\n".join(" ".join([word().capitalize(), *[word() for _ in range(rng.randint(7, 12))]]) for _ in range(rng.randint(lines - 6, lines + 6)))


def test_each_statistic_rejects_alone(spark):
    """One planted outlier of each statistic in each (lang, source)."""
    rng = random.Random(8)
    rows, planted = [], {}
    for g, (lang, source) in enumerate([("en", "a"), ("en", "b"), ("de", "a")]):
        rows += [(1000 * g + i, quality_doc(rng), lang, source, 0) for i in range(150)]
        plain = quality_doc(rng).split("\n")
        words = " ".join(plain).split()
        repeated_lines = rng.sample(words, 14) * 6
        rng.shuffle(repeated_lines)
        odd = {"words": " ".join(quality_doc(rng).replace("\n", " ") for _ in range(200)), "length": " ".join(w + "xyz" * 4 for w in words),
               "symbols": "\n".join(plain) + " #" * (len(words) // 8), "lines": "\n".join([*plain, *repeated_lines]),
               "repeated": "\n".join([*plain, " ".join(words[:int(0.31 * len(words))])]),
               "capitals": "\n".join(plain).upper()}
        for k, (name, text) in enumerate(odd.items()):
            planted[1000 * g + 900 + k] = name
            rows.append((1000 * g + 900 + k, text, lang, source, 0))
    got = {r.doc_id: r for r in quality_rules.robust_outliers(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert not any(got[i].base_failed for i in planted)
    assert [planted[i] for i in planted if got[i].kept] == []
    assert sum(got[r[0]].kept for r in rows if r[0] not in planted) >= 0.95 * 450


def test_outliers_that_are_many(spark):
    """A third of a group is one copied junk text, or distinct junk texts: all of it is rejected."""
    rng = random.Random(9)
    junk = lambda: quality_doc(rng).replace(" ", " #")
    copied = junk()
    rows = [(i, quality_doc(rng), "en", "copies", 0) for i in range(200)] + [(1000 + i, copied, "en", "copies", 0) for i in range(100)]
    rows += [(2000 + i, quality_doc(rng), "en", "distinct", 0) for i in range(200)] + [(3000 + i, junk(), "en", "distinct", 0) for i in range(100)]
    got = quality_rules.robust_outliers(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()
    bad = [r for r in got if r.doc_id % 2000 >= 1000]
    assert len(got) == 600 and not any(r.base_failed or r.kept for r in bad)
    assert sum(r.kept for r in got) >= 0.95 * 400


# ------------------------------------------------------------------ 9 chat

def test_chat_round_trip(spark):
    rng = random.Random(6)
    texts = ["", "<|im_end|>", r"<\|x", "a\nb", "<|im_start|>user\n", "word " * 40, "long " * 900, "ünï <\\\\|"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|"]), rng.choice([*texts, None]))
            for c in (1, 2, None) for t in [*range(150), None, 3, 3]]
    rows += [(7, 0, "system", "be brief")] + [(7, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(1, 40)] + [(8, 0, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    w = chat.windows(df)
    got = {r.conv_id: r for r in chat.digest(w).collect()}
    for conv in (1, 2, None, 7, 8):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    parts = w.collect()
    assert all(p.tokens <= chat.BUDGET or p.n_turns == 1 for p in parts)
    assert all(p.text.startswith("<|im_start|>system\nbe brief") for p in parts if p.conv_id == 7)
    assert sum(p.n_repeated > 1 for p in parts if p.conv_id == 7)  # history is repeated besides the system turn


# ------------------------------------------------------------------ 10 packing

def naive_best_fit(pieces, capacity):
    bins, out = [], []
    for size, s, c in pieces:
        fit = [(capacity - u, b) for b, (u, ss, cc) in enumerate(bins) if u + size <= capacity and s not in ss and c not in cc]
        if fit:
            b = min(fit)[1]
            u, ss, cc = bins[b]
            bins[b] = (u + size, ss | {s}, cc | {c})
        else:
            b = len(bins)
            bins.append((size, {s}, {c}))
        out.append(b)
    return out


def test_best_fit_against_naive():
    rng = random.Random(8)
    for _ in range(20):
        pieces = sorted(((rng.randint(0, 50), rng.randint(0, 4), rng.randint(100, 120)) for _ in range(200)), reverse=True)
        assert packing.best_fit(pieces, 60) == naive_best_fit(pieces, 60)


def test_packing(spark, docs_of, odd_rows):
    rows = odd_rows + [(100 + i, "same text here") for i in range(30)]
    got = packing.pack(docs_of(rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 9)), capacity=100, block_rows=20).collect()
    n = {i: len(SPACE_WORD.findall(t or "")) for i, t in rows}
    for i in n:
        mine = [p for p in got if p.doc_id == i]
        copies = sum(r[0] == i for r in rows)
        assert sum(p.n_tokens for p in mine) == n[i] * copies and all(p.n_tokens <= 100 for p in mine)
    bins = defaultdict(list)
    for p in got:
        bins[(p.block, p.bin)].append(p)
    for ps in bins.values():
        ps.sort(key=lambda p: p.slot)
        assert sum(p.n_tokens for p in ps) <= 100 and len({p.source for p in ps}) == len(ps) == len({p.cluster for p in ps})
        assert [p.offset for p in ps] == [sum(q.n_tokens for q in ps[:k]) for k in range(len(ps))]


# ------------------------------------------------------------------ all: empty tables

def test_empty_tables(spark):
    docs, labels = table(spark, SF, "documents").limit(0), table(spark, SF, "labels").limit(0)
    bench = table(spark, SF, "benchmark").limit(0)
    for df in (near_dup.near_duplicates(docs), near_dup.keep_one(docs), quality_model.quality_scores(docs, labels), sharding.shards(docs),
               decontaminate.hits(docs, bench), language_model.lm_scores(docs), licences.scan(docs, licences.known_texts(spark)),
               token_counts.token_counts(docs), quality_rules.robust_outliers(docs), quality_rules.keep_inliers(docs), packing.pack(docs),
               chat.digest(chat.windows(table(spark, SF, "conversations").limit(0)))):
        assert df.count() == 0


@pytest.mark.parametrize("split", [1.0, 0.5])
def test_components_against_union_find(spark, split):
    """Paths, a star, repeated, reversed and self links; all at once, or the second half merged into the first."""
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(900, i) for i in range(200, 240)] + [(7, 7), (5, 6), (6, 5), (5, 6)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)]
    rng.shuffle(links)
    root = {x: x for pair in links for x in pair}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    cut = int(len(links) * split)
    frame = lambda part: spark.createDataFrame(part, "a bigint, b bigint")
    label = near_dup.components(frame(links[:cut]))
    if cut < len(links):
        label = near_dup._merged(label, frame(links[cut:]))
    got = label.collect()
    found = {r.rid: r.comp for r in got}
    assert len(got) == len(found)
    assert {x: found.get(x, x) for x in root} == {x: top(x) for x in root}


def test_components_without_links(spark):
    assert near_dup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_verify_splits_hot_hubs(spark, monkeypatch):
    """A hub of many pairs meets them under several keys; each pair is verified once, as one by one."""
    monkeypatch.setattr(near_dup, "HUB_PAIRS", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = f"e{rng.random()}"
        texts.append(" ".join(t))
    rows = spark.createDataFrame(list(enumerate(texts)), "rid bigint, text string")
    own = near_dup.own_texts(rows, spark.range(40).select(F.col("id").alias("rid")))
    pairs = [(7, i) for i in range(40) if i != 7] + [(39, 2), (3, 38)]
    got = near_dup.verify(spark.createDataFrame(pairs, "a bigint, b bigint"), own, 0.8, 5).collect()
    sets = [shingle_counts(t) for t in texts]
    want = [(a, b) for a, b in pairs
            if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()) - 1e-9]
    assert sorted((r.a, r.b) for r in got) == sorted(want) and 0 < len(want) < len(pairs)


def test_texts_are_shuffled_once(spark):
    """Joins on the row id shuffle ids, not the bucketed texts."""
    rows = spark.range(300).select(F.col("id").alias("rid"), F.concat(F.lit("t "), "id").alias("text"))
    own = near_dup.own_texts(rows, spark.range(200).select(F.col("id").alias("rid")))
    assert own.count() == 200
    joined = near_dup._with_text(spark.range(50).select(F.col("id").alias("b")), own, "b", "tb")
    plan = joined._jdf.queryExecution().sparkPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(b") <= 1 and "Bucketed: true" in plan and joined.count() == 50
