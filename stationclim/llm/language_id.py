"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

A text is the bag of its subwords: runs of 1 to ``MAX_GRAM`` characters inside a
word (a maximal run of letters, lower-cased, with a mark on each side).  A
subword is hashed to one of ``BUCKETS`` embeddings; the text's vector is the
average over all its subwords, and a linear softmax over the languages follows.
Both layers are trained together by stochastic gradient descent in numpy.
Because the model is linear in the average, embeddings times weights give one
number for each bucket and language, and a task scores a whole text by adding up
rows of that table.

*Sample.*  Documents with a language that are not held out are drawn by a hash
of id and text, at a rate for each language that aims at the same number, so
rare languages are all taken and the most frequent one does not crowd out the
others.  ``MAX_TRAIN`` bounds the documents and ``MAX_ENTRIES`` the subword
counts that reach the driver; the ``MAX_LANGS`` most frequent languages are
learned.  Everything else (the language counts, the scores) covers all rows.

*Calibration.*  ``CALIBRATE`` of the sample is not trained on.  A temperature is
fitted on it by Newton steps on its log-loss; of the calibrated scores, the
``ALPHA`` quantile of those of the right languages is the least score that is
accepted (split conformal), so that about that share of texts in a known
language is rejected.

Defined results
---------------
* null, empty and letterless texts: ``und``, score 0, rejected.
* null languages and null ids: not learned from; null ids are scored, and count
  as not held out where a crc32 of the empty text says so.
* repeated rows and ids: each is scored; copies of one text under one id are
  drawn together.
* one language: it is predicted with score 1; none: ``und`` with score 0.
* ties: the language that comes first in the order of names.
* an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, crc_mod, materialise, slices
from .textvec import mix

BUCKETS = 1 << 15
DIM = 16
MAX_GRAM = 4
MAX_TRAIN = 6_000        # documents of the sample
MAX_ENTRIES = 12_000_000  # distinct subwords of them, summed (8 bytes each)
MAX_LANGS = 200
CALIBRATE = 5            # every fifth document of the sample
ALPHA = 0.01
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.5, 3
HELD_MODULUS, HELD_REMAINDER = 4, 2
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point whether it is a letter (category L)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts' words, each word with a mark (0) behind it, and the text of each place."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()
    flat = "\n".join([*low, ""])  # a line feed is no letter, so no word spans two texts
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low)) + 1
    row = np.repeat(np.arange(len(low)), size)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(0))
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before  # of a run of other characters the first, as the mark after a word
    return code[keep], row[keep]


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every subword of every text, one entry for each occurrence."""
    code, row = characters(texts)
    n = code.size
    # A mark before the first word of each text makes its first subwords like those of other words.
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.zeros(0, np.int64)
    code, row = np.insert(code, first, 0), np.insert(row, first, row[first] if n else 0)
    n = code.size
    mark = code == 0
    c = code.astype(np.uint64)
    buckets, rows = [], []
    h = np.zeros(n, np.uint64)
    for g in range(1, MAX_GRAM + 1):
        m = n - g + 1
        if m <= 0:
            break
        h = mix(h[:m] * np.uint64(0x100000001B3) + c[g - 1:] + np.uint64(1))
        # Marks stand at the ends only, and not alone.
        ok = row[:m] == row[g - 1:]
        if g == 1:
            ok = ok & ~mark
        else:
            for j in range(1, g - 1):
                ok &= ~mark[j:j + m]
            ok &= ~(mark[:m] & mark[g - 1:]) if g == 2 else True
        buckets.append((h[ok] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        rows.append(row[:m][ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


# --------------------------------------------------------------------------- sample

def _learnable(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (crc_mod("doc_id", HELD_MODULUS) != HELD_REMAINDER)
    return docs.where(usable).select(F.col("lang").cast("string").alias("lang"), text.alias("text"),
                                     F.xxhash64("doc_id", text, F.lit("language")).alias("h"))


def language_counts(docs: DataFrame) -> dict[str, int]:
    """Documents to learn from of the ``MAX_LANGS`` most frequent languages."""
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (crc_mod("doc_id", HELD_MODULUS) != HELD_REMAINDER)
    found = docs.where(usable).groupBy(F.col("lang").cast("string").alias("lang")).count()
    return {r["lang"]: r["count"] for r in found.orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}


def _rates(counts: dict[str, int], total: int) -> dict[str, float]:
    """A share for each language so that the languages have equal numbers, as far as they go, and ``total`` together."""
    out, left, langs = {}, total, len(counts)
    for lang, n in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        take = min(n, left / langs)
        out[lang], left, langs = take / n, left - take, langs - 1
    return out


def sample(docs: DataFrame, max_train: int | None = None, max_entries: int | None = None) -> list:
    """[(language, bucket numbers, counts)] of the drawn documents, in the order of their hashes."""
    max_train, max_entries = max_train or MAX_TRAIN, max_entries or MAX_ENTRIES
    counts = language_counts(docs)
    if not counts:
        return []
    # The rate aims a little lower than the bound, which the cut below holds exactly.
    limit = {k: int(r * 0.95 * 2 ** 63) if r < 1 else 2 ** 63 - 1 for k, r in _rates(counts, max_train).items()}
    langs = docs.sparkSession.createDataFrame([(k, v) for k, v in sorted(limit.items())], "known string, below bigint")
    drawn = _learnable(docs).join(F.broadcast(langs), F.col("lang") == F.col("known")).where(
        F.col("h").bitwiseAND(2 ** 63 - 1) <= F.col("below")).select("lang", "h", "text")  # langs: at most MAX_LANGS rows

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                bucket, row = subwords(piece.column(2))
                key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(piece.num_rows + 1) * BUCKETS)
                ids, count = (key % BUCKETS).astype("<i4"), count.astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(np.diff(cut), pa.int64()),
                     pa.array([ids[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([count[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["lang", "h", "n", "ids", "counts"])

    bags = materialise(drawn.mapInArrow(run, "lang string, h bigint, n bigint, ids binary, counts binary").where("n > 0"), "lang-bags")
    # Whole documents in the order of a hash that knows no language, until one of the bounds is met.
    order = F.xxhash64("h", F.lit("cut"))
    heads = bags.select(order.alias("o"), "n").orderBy("o", "n").limit(max_train).collect()
    taken = int(np.searchsorted(np.cumsum([r["n"] for r in heads]), max_entries, "right"))
    if not taken:
        return []
    rows = bags.withColumn("o", order).where(F.col("o") <= heads[taken - 1]["o"]).orderBy(
        "o", "n", "lang", "ids", "counts").limit(taken).collect()
    return [(r["lang"], np.frombuffer(r["ids"], "<i4").astype(np.int64), np.frombuffer(r["counts"], "<f4")) for r in rows]


# --------------------------------------------------------------------------- model

def _dense(bags: list, which) -> np.ndarray:
    x = np.zeros((len(which), BUCKETS), np.float32)
    for k, w in enumerate(which):
        _, ids, count = bags[w]
        x[k, ids] = count / count.sum()
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(bags: list, langs: list[str], which, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and offsets by stochastic gradient descent on batches of ``BATCH`` documents."""
    rng = np.random.default_rng(SEED)
    place = {k: i for i, k in enumerate(langs)}
    y = np.array([place[bags[w][0]] for w in which])
    weight = (len(y) / (len(langs) * np.maximum(np.bincount(y, minlength=len(langs)), 1)))[y]  # languages count alike
    emb = rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    total, step = epochs * -(-len(which) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(which))
        for at in range(0, len(order), BATCH):
            take = order[at:at + BATCH]
            rate = RATE * (1 - step / total)
            step += 1
            x = _dense(bags, [which[t] for t in take])
            used = np.flatnonzero(x.any(0))
            x = x[:, used]
            h = x @ emb[used]
            g = _softmax(h @ out + bias)
            g[np.arange(len(take)), y[take]] -= 1
            g *= (weight[take] / len(take))[:, None]
            back = g @ out.T
            out -= rate * (h.T @ g)
            bias -= rate * g.sum(0)
            emb[used] -= rate * BUCKETS ** 0.5 * (x.T @ back)  # a bucket's share of a text is small
    return emb, out, bias


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The inverse temperature with the least log-loss, by Newton steps kept inside [0.01, 100]."""
    b = 1.0
    for _ in range(50):
        p = _softmax(b * z)
        mean = (p * z).sum(1)
        slope = (mean - z[np.arange(len(y)), y]).mean()
        curve = ((p * z * z).sum(1) - mean ** 2).mean()
        new = float(np.clip(b - slope / max(curve, 1e-12), max(0.01, b / 4), min(100.0, b * 4)))
        if abs(new - b) < 1e-9:
            break
        b = new
    return b


def fit(docs: DataFrame, **bounds) -> dict:
    """The model: languages, bucket table, offsets, inverse temperature and the least accepted score."""
    bags = sample(docs, **bounds)
    langs = sorted({b[0] for b in bags})
    if len(langs) < 2:
        return {"langs": langs}
    held = [k for k in range(len(bags)) if k % CALIBRATE == 0]
    used = [k for k in range(len(bags)) if k % CALIBRATE]
    if len({bags[k][0] for k in used}) < len(langs):
        used = list(range(len(bags)))  # too few documents to spare any
    emb, out, bias = train(bags, langs, used)
    table = emb @ out
    seen = np.zeros(BUCKETS, bool)
    for k in used:
        seen[bags[k][1]] = True
    table[~seen] = 0  # an embedding without training says nothing
    z = np.concatenate([_dense(bags, held[a:a + 256]) @ table for a in range(0, len(held), 256)]).astype(float) + bias
    y = np.array([langs.index(bags[k][0]) for k in held])
    b = temperature(z, y)
    right = np.sort(_softmax(b * z)[np.arange(len(y)), y])
    return {"langs": langs, "table": table.astype(np.float64), "bias": bias.astype(np.float64), "beta": b,
            "least": float(right[int(ALPHA * (len(right) + 1))])}


def _scorer(model: dict):
    langs = model["langs"]

    def make(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        bucket, row = subwords(texts)
        count = np.bincount(row, minlength=n)
        some = count > 0
        best, score = np.zeros(n, np.int64), np.where(some, 1.0, 0.0)
        if len(langs) > 1:
            z = np.stack([np.bincount(row, weights=model["table"][bucket, k], minlength=n) for k in range(len(langs))], 1)
            p = _softmax(model["beta"] * (z / np.maximum(count, 1)[:, None] + model["bias"]))
            best, score = p.argmax(1), np.where(some, p.max(1), 0.0)
        elif not langs:
            some, score = np.zeros(n, bool), np.zeros(n)
        names = np.array([*langs, UNKNOWN], object)[np.where(some, best, len(langs))]
        accepted = some & (score >= model.get("least", 0.0))
        return [pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(accepted)]

    return make


def identify(docs: DataFrame, model: dict) -> tuple[DataFrame, list[str]]:
    """``docs`` with the language, its score and whether it is accepted, and the names of these columns."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return append_columns(docs, F.col("text"), fields, _scorer(model))


def languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted."""
    out, (pred, score, accepted) = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (crc_mod("doc_id", HELD_MODULUS) == HELD_REMAINDER).alias("held_out"), F.col(pred).alias("lang_pred"),
                      F.col(score).alias("score"), F.col(accepted).alias("accepted"))
