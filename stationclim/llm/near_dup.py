"""Near-duplicates: BagMinHash signatures, banding, exact multiset verification.

A text is the multiset of its 5-word shingles (words of digits, letters and
non-ASCII characters, A-Z lower-cased).  Two texts are linked if the weighted
Jaccard similarity of their multisets is at least ``THRESHOLD``; classes are
the connected components of the links.

Signatures.  Weights (counts) are discretised at the integers and arranged in
a hierarchy of intervals: (0,1], (1,2], (2,4], (4,8], ...  Every shingle has
one Poisson process per interval below its weight, with the interval's width
as its rate; a point carries a signature component and a place in the
interval, and counts only if that place lies below the weight.  A component's
value is its first point in time.  Points of equal shingles are equal in all
texts, so two texts agree in a component with a probability equal to their
weighted Jaccard similarity.  Points are made in the order of time and only
up to the time at which all components are certain to be filled, so a long
text costs little more than one point per shingle.

Search.  Equal texts become one representative first.  ``BANDS`` bands of
``ROWS`` components give buckets; a pair at the threshold meets in at least
one with probability 1 - (1 - 0.8^8)^48 > 0.9998.  In each bucket all members
are verified against one hub.  Buckets whose members then still belong to
several classes get new hubs, twice.  The signed rows are shuffled once, into a
table bucketed by row id that is the only copy of the texts; a round shuffles
ids, and one text for every pair it verifies, and ``keep_one`` picks its rows by
a shuffle of ids.  A hub with many partners is split over several keys.
What is still open (dense groups just
below the threshold) is compared exactly in blocks: texts connected by open
buckets are dealt into blocks of about ``BLOCK`` rows, one task compares two
blocks by a product of their shingle matrices, and only links leave it.
Blocks of one and the same class are not compared, since pairs inside a class
cannot change it; so no link between classes is lost, no group of copies is
multiplied out and no list of candidate pairs is built.

Defined results: texts of fewer than five words, but not none, are one
shingle; texts without a word are linked with equal texts only; null counts
as empty; ties go to the smallest row id; repeated rows fall in one class;
an empty table gives no rows; ``keep_one`` keeps all columns, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizing import broadcast_if_small
from . import textvec as tv
from .common import append_columns, arrow_rows, discard, fresh, materialise, materialise_bucketed, slices

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 48
ROWS = 8
EXTRA_ROUNDS = 2
BLOCK = 64
HUB_PAIRS = 2_000  # pairs of a hub that meet in one key
COLUMNS = 8_192  # shingles of a block pair that are multiplied at once

_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def _times(k: int) -> np.uint64:
    """k times the odd constant, modulo 2^64."""
    return np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)


def text_multisets(texts: pa.Array, size: int = SHINGLE):
    """(element, row, count) of all texts, sorted by row."""
    data, off = tv.text_bytes(texts)
    m, s, e, row = tv.split_words(data, off, tv.alnum_table())
    return tv.multiset(*tv.shingles(tv.hash_words(m, s, e), row, len(texts), size))


def _processes(elem, row, count):
    """One Poisson process per element and weight interval: seed, row, rate, share of the interval below the weight."""
    seeds, rows, rates, shares = [tv.mix(elem + _GAMMA)], [row], [np.ones(row.size)], [np.ones(row.size)]
    low = 1
    while True:
        at = np.flatnonzero(count > low)
        if not at.size:
            break
        seeds.append(tv.mix(elem[at] + _times(low + 1)))
        rows.append(row[at])
        rates.append(np.full(at.size, float(low)))
        shares.append(np.minimum((count[at] - low) / low, 1.0))
        low *= 2
    return tuple(np.concatenate(x) for x in (seeds, rows, rates, shares))


def signatures(elem, row, count, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) first times per component; a row without elements stays infinite."""
    sig = np.full(n_rows * m, np.inf)
    if not row.size:
        return sig.reshape(n_rows, m)
    weight = np.bincount(row, weights=count, minlength=n_rows)
    limit = m * (np.log(m) + 4.0) / np.maximum(weight, 1.0)
    seeds, rows, rates, shares = _processes(elem, row, count)
    todo = weight > 0
    while todo.any():
        act = np.flatnonzero(todo[rows])
        seed, r, rate, share = seeds[act], rows[act], rates[act], shares[act]
        t = np.zeros(act.size)
        step = 0
        while seed.size:
            step += 1
            x = tv.mix(seed + _times(step))
            t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate
            live = np.flatnonzero(t <= limit[r])
            seed, r, rate, share, t, x = seed[live], r[live], rate[live], share[live], t[live], x[live]
            y = tv.mix(x ^ _GAMMA)
            comp = ((y >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            inside = (y & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0 ** -32 < share
            np.minimum.at(sig, (r * m + comp.astype(np.int64))[inside], t[inside])
        todo = todo & np.isinf(sig.reshape(n_rows, m)).any(axis=1)
        limit = np.where(todo, 2.0 * limit, limit)
    return sig.reshape(n_rows, m)


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """One hash per row and band; times are compared in single precision, so that no last bit of a logarithm matters."""
    v = sig.astype(np.float32).view(np.uint32).reshape(sig.shape[0], bands, -1).astype(np.uint64)
    acc = np.broadcast_to(tv.mix(np.arange(1, bands + 1, dtype=np.uint64) * _GAMMA), v.shape[:2]).copy()
    for j in range(v.shape[2]):
        acc = tv.mix(acc * _GAMMA + v[:, :, j])
    return acc.view(np.int64)


def _sign(bands: int, rows: int, size: int):
    def make(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        elem, row, count = text_multisets(texts, size)
        weight = np.bincount(row, weights=count, minlength=n).astype(np.int64)
        hashes = band_hashes(signatures(elem, row, count, n, bands * rows), bands)
        has = weight > 0
        off = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
        return [pa.array(weight), pa.ListArray.from_arrays(pa.array(off), pa.array(hashes[has].ravel()))]

    return make


FIELDS = [T.StructField("weight", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def overlap(a: pa.Array, b: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the intersection and the union of two columns of texts, row by row."""
    shift = np.uint64(43)
    (ea, ra, ca), (eb, rb, cb) = text_multisets(a, size), text_multisets(b, size)
    ka, kb = (ra.astype(np.uint64) << shift) | ea, (rb.astype(np.uint64) << shift) | eb
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(ra[ia], weights=np.minimum(ca[ia], cb[ib]), minlength=len(a))
    total = np.bincount(ra, weights=ca, minlength=len(a)) + np.bincount(rb, weights=cb, minlength=len(a))
    return both, total - both


def own_rows(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """``rows`` (bucketed by row id) whose row id is in ``reps``; ids are shuffled, and a task's hash table holds ids."""
    return rows.join(reps.hint("shuffle_hash"), "rid", "left_semi")


def own_texts(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """``rows`` whose row id is in ``reps`` (rid), as a table bucketed by row id."""
    return materialise_bucketed(own_rows(rows, reps), "dup_texts", "rid")


def _with_text(ids: DataFrame, texts: DataFrame, rid: str, text: str) -> DataFrame:
    """``ids`` and the text of their row id ``rid``; the hash table of a task holds ids, never texts."""
    return texts.select(F.col("rid").alias(rid), F.col("text").alias(text)).join(ids.hint("shuffle_hash"), rid)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) of row ids whose texts are similar enough, written to the scratch folder.

    ``a`` is a hub that may have any number of partners, ``b`` has at most one a
    bucket.  Every pair takes b's text along to the hub's; a hub of more than
    ``HUB_PAIRS`` pairs is split over that many more keys, each with a copy of its text.
    """
    hubs = materialise(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("long").alias("parts")), "dup-hub-parts")
    split, _ = broadcast_if_small(hubs.where("parts > 1"))
    salted = pairs.join(split, "a", "left").select(
        "a", "b", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("b"), "parts")).alias("salt"))
    hub_texts = _with_text(hubs, texts, "a", "ta").select("a", "ta", F.explode(F.expr("sequence(0L, parts - 1)")).alias("salt"))
    wide = _with_text(salted, texts, "b", "tb").join(hub_texts, ["a", "salt"]).select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ta"):
                both, union = overlap(part.column(2), part.column(3), size)
                keep = pa.array(both >= threshold * union - 1e-9) if part.num_rows else pa.array([], pa.bool_())
                yield part.select([0, 1]).filter(keep)

    with arrow_rows(pairs.sparkSession, 200):
        return materialise(wide.mapInArrow(run, "a bigint, b bigint"), "dup-links")


def components(links: DataFrame) -> DataFrame:
    """(rid, comp) of all linked rows; comp is the smallest row id of the component.

    Contraction: every node goes to the node of least (random) priority next to
    it, and on to that one's; links between the nodes that remain are the next
    round's.  Links inside what has been joined are gone, so the rounds together
    cost little more than the first.  Then the rounds' steps are put together,
    from the last to the first.
    """
    edges = materialise(links.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "dup-edges")
    steps = []
    while edges.head(1):
        turn = F.lit(len(steps))
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, turn).alias("p"), F.col(c).alias("id"))
        near = sides.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(rank("a"), "m")["id"].alias("up"))
        near = materialise(near, "dup-near")
        over = near.select(F.col("a").alias("up"), F.col("up").alias("to"))
        step = materialise(near.join(over, "up").select("a", "to"), "dup-step")
        steps.append(step)
        edges = materialise(
            edges.join(step, "a").select("b", F.col("to").alias("x"))
            .join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "dup-edges")
    if not steps:
        return edges.select(F.col("a").alias("rid"), F.col("b").alias("comp"))
    found = steps.pop()
    while steps:
        later = found.select(F.col("a").alias("to"), F.col("to").alias("root"))
        found = materialise(steps.pop().join(later, "to", "left").select("a", F.coalesce("root", "to").alias("to")), "dup-roots")
    least = materialise(found.groupBy("to").agg(F.min("a").alias("comp")), "dup-least")
    return materialise(found.join(least, "to").select(F.col("a").alias("rid"), "comp"), "dup-labels")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` after more links: only links between different components are looked at."""
    ends = links.select(F.col("a").alias("rid")).unionByName(links.select(F.col("b").alias("rid"))).distinct()
    known = materialise(ends.join(label, "rid", "left").select("rid", F.coalesce("comp", "rid").alias("comp"), F.col("comp").isNull().alias("added")), "dup-ends")
    side = lambda c, to: known.select(F.col("rid").alias(c), F.col("comp").alias(to))
    joined = components(links.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    every = label.unionByName(known.where("added").select("rid", "comp"))
    return materialise(every.join(joined.select(F.col("rid").alias("comp"), F.col("comp").alias("root")), "comp", "left").select(
        "rid", F.coalesce("root", "comp").alias("comp")), "dup-labels")


def _open_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, rid, weight, comp) of buckets whose members belong to several classes."""
    placed = materialise(members.select("bucket", "rid", "weight").join(label, "rid", "left").select(
        "bucket", "rid", "weight", F.coalesce("comp", "rid").alias("comp")), "dup-placed")
    several = materialise(placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                          .where(F.col("lo") != F.col("hi")).select("bucket"), "dup-open")
    out = materialise(placed.join(several, "bucket"), "dup-members")
    discard(placed)
    return out


def _block_links(texts: pa.Array, size: int, threshold: float) -> np.ndarray:
    """Matrix of all pairs of texts that are similar enough."""
    n = len(texts)
    elem, row, count = text_multisets(texts, size)
    # The k-th copy of a shingle is a token of its own: multisets become sets.
    each = np.repeat(np.arange(row.size), count)
    copy = np.arange(each.size) - np.repeat(np.cumsum(count) - count, count)
    token, column = np.unique(tv.mix(elem[each] + copy.astype(np.uint64) * _GAMMA), return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, who = column[order], row[each][order]
    both = np.zeros((n, n))
    for at in range(0, token.size, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((n, min(COLUMNS, token.size - at)), np.float32)
        part[who[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    weight = np.diag(both)
    return both >= threshold * (weight[:, None] + weight - both) - 1e-9


def _compare_blocks(members: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links (a, b) between classes among texts that open buckets connect."""
    first = materialise(members.groupBy("bucket").agg(F.min("rid").alias("a")), "dup-firsts")
    near = members.select("bucket", F.col("rid").alias("b")).join(first, "bucket").where(F.col("a") != F.col("b"))
    group = components(near.select("a", "b").distinct()).withColumnRenamed("comp", "grp")
    open_rows = materialise(members.select("rid", "comp").distinct().join(group, "rid"), "dup-open-rows")
    # A large class has blocks of its own, the small ones of a group share blocks.
    sizes = materialise(open_rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n")), "dup-class-sizes")
    small = sizes.where(F.col("n") < BLOCK // 2).groupBy("grp").agg(F.sum("n").alias("pooled"))
    sizes = materialise(sizes.join(small, "grp", "left").select(
        "grp", "comp", F.when(F.col("n") >= BLOCK // 2, F.col("comp")).alias("whole"),
        F.ceil(F.when(F.col("n") >= BLOCK // 2, F.col("n")).otherwise(F.col("pooled")) / BLOCK).alias("parts")), "dup-parts")
    dealt = open_rows.join(sizes, ["grp", "comp"])
    part = F.pmod(F.xxhash64(F.when(F.col("whole").isNull(), F.col("comp")).otherwise(F.col("rid"))), F.col("parts"))
    dealt = materialise(dealt.select("grp", "rid", "comp", "whole", F.struct(
        F.coalesce("whole", F.lit(-1)).alias("c"), part.alias("p")).alias("block")), "dup-dealt")
    blocks = materialise(dealt.select("grp", "block", "whole").distinct(), "dup-blocks")
    pairs = blocks.join(blocks.select("grp", F.col("block").alias("other"), F.col("whole").alias("other_whole")), "grp").where(
        (F.col("block") <= F.col("other")) & ~(F.col("whole").isNotNull() & F.col("whole").eqNullSafe(F.col("other_whole"))))
    pairs = materialise(pairs.select("grp", "block", "other", F.xxhash64("grp", "block", "other").alias("pair")), "dup-block-pairs")
    sides = pairs.select("grp", "block", "pair").unionByName(
        pairs.where(F.col("block") != F.col("other")).select("grp", F.col("other").alias("block"), "pair"))
    placed = materialise(dealt.join(sides, ["grp", "block"]).select("pair", "rid", "comp"), "dup-block-rows")
    # A row of a large group is in many pairs: the merge join streams them, a hash table would hold them.
    wide = texts.select("rid", "text").join(placed, "rid").select("pair", "rid", "comp", "text")

    def compare(f):
        import pandas as pd

        f = f.drop_duplicates("rid").reset_index(drop=True)
        link = _block_links(pa.array(f["text"], pa.string()), size, threshold)
        comp, rid = f["comp"].to_numpy(), f["rid"].to_numpy()
        x, y = np.nonzero(np.triu(link & (comp[:, None] != comp), 1))
        return pd.DataFrame({"a": rid[x], "b": rid[y]})

    return materialise(wide.groupBy("pair").applyInPandas(compare, "a bigint, b bigint").distinct(), "dup-links")


def _new_pairs(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """(a, b, hub) of pairs (x, hub y) that were not verified before; a < b, one of them the hub."""
    ordered = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("y").alias("hub"))
    return materialise(ordered.join(tested, ["a", "b"], "left_anti"), "dup-pairs")


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` with row id, digest, weight and band hashes, bucketed by row id in the scratch folder.

    A row id is a row's place in ``docs``, so ``docs`` must give its rows in the
    same order when a task is repeated, as a scan of files does.
    """
    rid = fresh("__rid", docs.columns)
    digest = fresh("__digest", docs.columns)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("*", F.monotonically_increasing_id().alias(rid), F.unhex(F.md5(text.cast("binary"))).alias(digest))
    signed, names = append_columns(keyed, F.col("text"), FIELDS, _sign(bands, rows, size))
    return materialise_bucketed(signed, "dup_signed", rid), {"rid": rid, "digest": digest, "weight": names[0], "bands": names[1]}


def _linked(rows: DataFrame, reps: DataFrame, threshold: float, size: int) -> DataFrame:
    """(rid, comp) of the representatives (rid) that are linked with another one; ``rows`` is bucketed by row id."""
    near = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9  # noqa: E731  similarity is at most the ratio of weights

    every = materialise(own_rows(rows.select("rid", "weight", "bands"), reps).select("rid", "weight", F.explode("bands").alias("bucket")), "dup-bands")
    hubs = materialise(every.groupBy("bucket").agg(F.min("rid").alias("hub"), F.count(F.lit(1)).alias("n"))
                       .where(F.col("n") > 1).select("bucket", "hub"), "dup-hubs")
    members = materialise(every.join(hubs, "bucket"), "dup-buckets")
    discard(every)
    discard(hubs)
    tested = materialise(members.where(F.col("rid") != F.col("hub")).select(
        F.col("hub").alias("a"), F.col("rid").alias("b")).distinct(), "dup-pairs")
    label = components(verify(tested, rows, threshold, size))

    for i in range(EXTRA_ROUNDS + 1):
        before, members = members, _open_buckets(members, label)
        discard(before)
        if not members.head(1):
            break
        if i < EXTRA_ROUNDS:
            hub = materialise(members.groupBy("bucket").agg(
                F.min(F.struct(F.xxhash64("rid", "bucket", F.lit(i)), "rid", "comp", "weight")).alias("h")).select(
                "bucket", F.col("h.rid").alias("y"), F.col("h.comp").alias("hc"), F.col("h.weight").alias("hw")), "dup-hubs")
            found = members.join(hub, "bucket").where((F.col("comp") != F.col("hc")) & near(F.col("weight"), F.col("hw")))
            pairs = _new_pairs(found.select(F.col("rid").alias("x"), "y"), tested)
            tested = tested.unionByName(pairs.select("a", "b"))
            other = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
            more = verify(pairs.select(F.col("hub").alias("a"), other.alias("b")), rows, threshold, size)
        else:
            more = _compare_blocks(members, rows, threshold, size)
        if more.head(1):
            label = _merged(label, more)
    return label


def classes(signed: DataFrame, names: dict[str, str], threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(rid, class_id) of every row; class_id is the smallest row id of the class."""
    rows = signed.select(*[F.col(c).alias(k) for k, c in names.items()],
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # One representative of equal texts.
    reps = materialise(rows.groupBy("digest").agg(F.min("rid").alias("rep")), "dup-reps")
    label = _linked(rows.select("rid", "weight", "bands", "text"), reps.select(F.col("rep").alias("rid")), threshold, size)
    by_text = materialise(reps.join(label, reps["rep"] == label["rid"], "left").select(
        "digest", F.coalesce("comp", "rep").alias("class_id")), "dup-classes")
    return rows.select("rid", "digest").join(by_text, "digest").select("rid", "class_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id (equal for near-duplicates), representative (least doc_id of the class), class_rows."""
    signed, names = sign(docs.select("doc_id", "text"))
    found = materialise(classes(signed, names, threshold).join(
        signed.select(F.col(names["rid"]).alias("rid"), "doc_id"), "rid"), "dup-result")
    by_class = materialise(found.groupBy("class_id").agg(
        F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("class_rows")), "dup-sizes")
    return found.join(by_class, "class_id").select("doc_id", "class_id", "representative", "class_rows")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with its own columns: the least doc_id, then the first row; no text is shuffled for it."""
    signed, names = sign(docs)
    rid = names["rid"]
    found = classes(signed, names, threshold).join(
        signed.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("d")), "rid")
    stays = materialise(found.groupBy("class_id").agg(F.min(F.struct(F.col("d").isNull(), "d", "rid")).alias("s")).select(
        F.col("s.rid").alias(rid)), "dup-stays")
    return signed.join(stays.hint("shuffle_hash"), rid, "left_semi").select(*docs.columns)
