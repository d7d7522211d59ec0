"""Filter interaction audit over sorted posting lists.

Five filters are judged on every whole text; the audit tells, for each part of
the corpus and each of the 120 orders in which the filters can be applied, what
every step keeps and removes, and what a filter removes that no other would.

1. *Failures.*  One pass over the texts gives filters A to D and a digest of the
   text; E (a smaller doc_id has the same text) is a hash join with the least
   doc_id of each repeated digest.  Digests that hold more than one row in
   ``HOT_SHARE`` are at most ``HOT_SHARE`` many and are broadcast, so no task
   gets a hot text's rows.
2. *Posting lists.*  Consecutive rows form an id range of at most ``RANGE_ROWS``
   rows, sorted by part, so that a part is a sub-range.  For each filter the
   range keeps the sorted list of its failing ids, and so it does for the two
   labels.  The lists are written; a range's size is bounded, however large a
   part is.
3. *Merges.*  The size of ``fails f and none of P`` is needed for each filter f
   and each set P of other filters, 80 sizes in all, and the same within the
   labelled lists.  A galloping merge looks the ids of the list that remains up
   in the next list of P, from where the id before was found; sizes per part are
   read off at the parts' borders.  Ranges are disjoint, so sizes add up.
4. *Steps.*  Every figure of the 120 x 5 steps is a sum of these sizes.

Defined results
---------------
* null text: the empty text; null source: the part ``""``, as an empty source.
* null doc_id: neither fails E nor makes another row fail; it has no labels.
* repeated doc_id: rows are judged one by one; equal texts under one doc_id do
  not make each other fail E; all have the doc_id's labels.
* several labels for a doc_id: quality 1 if any says 1, toxic 1 if any says 1;
  null labels are neither.
* an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
HOT_SHARE = 1_000     # a digest with more than this part of all rows is hot
RANGE_ROWS = 10_000   # rows of an id range
LISTS = (*FILTERS, "good", "toxic")

# Each filter f with each set of the others before it, as a bit mask.
PAIRS = [(f, p) for f in range(5) for p in range(32) if not p >> f & 1]
_AT = {fp: k for k, fp in enumerate(PAIRS)}
_KINDS = ("removed", "good_lost", "toxic_lost")

_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def judge(text: str) -> tuple[int, bytes]:
    """Failures of A to D as bits, and the text's digest."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at 0x20 and 0x09-0x0D only
    few = len(words) < MIN_WORDS
    same = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, _UPPER))) > MAX_UPPER_PERCENT * len(text)
    marks = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | same << 1 | loud << 2 | marks << 3, hashlib.blake2b(raw, digest_size=16).digest()


def failures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, part, bits, digest): filters A to D of every whole text."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                found = [judge(t) for t in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([b for b, _ in found], pa.int32()),
                     pa.array([d for _, d in found], pa.binary())], names=["doc_id", "part", "bits", "digest"])

    return rows.mapInArrow(run, f"doc_id {id_type}, part string, bits int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """``failures`` with the bit of filter E."""
    total = rows.count()
    same = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    same = materialise(same.withColumn("hot", F.col("copies") * HOT_SHARE > total).drop("copies"), "audit-copies")
    hot = same.where("hot").select("digest", F.col("first").alias("hot_first"))   # fewer than HOT_SHARE rows
    cold = same.where("not hot").select("digest", "first")
    marked = rows.join(F.broadcast(hot), "digest", "left")
    # A hot row needs no second lookup: its digest is not among the cold ones, and a random key spreads such rows.
    key = F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("doc_id")), 16, "0")))
    joined = marked.withColumn("digest", key).join(cold, "digest", "left")
    copy = F.coalesce(F.coalesce("hot_first", "first") < F.col("doc_id"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("bits") + F.when(copy, 16).otherwise(0)).alias("bits"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the bits of the labels: 32 good, 64 toxic."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 32).otherwise(0)).alias("q"), F.max(F.when(F.col("toxic") == 1, 64).otherwise(0)).alias("t")
    ).select(F.col("doc_id").alias("labelled"), (F.col("q") + F.col("t")).alias("label_bits")).where("label_bits > 0")
    named = rows.where(F.col("doc_id").isNotNull()).join(known, F.col("doc_id") == F.col("labelled"), "left")
    out = named.select("doc_id", "part", (F.col("bits") + F.coalesce("label_bits", F.lit(0))).alias("bits"))
    return out.unionByName(rows.where(F.col("doc_id").isNull()))  # null ids meet in no task


def posting_lists(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each id range and part: sorted failing ids of each filter and label.

    ``first_id`` and ``n_rows`` give the part's ids in the range; ``doc_ids``
    names the document of each.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<bigint>" for c in LISTS)

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, range_rows):
                piece = batch.slice(start, range_rows)
                order = np.argsort(np.asarray(piece.column(1).dictionary_encode().indices), kind="stable")
                piece = piece.take(pa.array(order))
                code = np.asarray(piece.column(1).dictionary_encode().indices)
                border = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
                bits = np.asarray(piece.column(2))
                cols = [piece.column(1).take(pa.array(border[:-1])), pa.array(at + border[:-1], pa.int64()),
                        pa.array(np.diff(border), pa.int64()), pa.ListArray.from_arrays(pa.array(border, pa.int32()), piece.column(0))]
                for k in range(len(LISTS)):
                    ids = np.flatnonzero(bits >> k & 1)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(ids, border), pa.int32()), pa.array(at + ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "first_id", "n_rows", "doc_ids", *LISTS])
                at += piece.num_rows

    return rows.mapInArrow(run, f"part string, first_id bigint, n_rows bigint, doc_ids array<{id_type}>, {lists}")


def gallop(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the sorted ``ids`` are in the sorted list ``other``.

    ``searchsorted`` goes on from the place of the id before, so a merge of a
    short list with a long one skips what lies between.
    """
    if not ids.size or not other.size:
        return np.zeros(ids.size, bool)
    at = np.searchsorted(other, ids)
    at[at == other.size] = 0
    return other[at] == ids


def difference_sizes(lists: list[np.ndarray], border: np.ndarray) -> np.ndarray:
    """[80 x 3, parts]: ids that fail f and none of P, and those of them on the good and on the toxic list.

    ``border`` holds the first id of each part and one past the last.
    """
    good, toxic = lists[5], lists[6]
    out = np.zeros((3 * len(PAIRS), border.size - 1), np.int64)
    for f in range(5):
        left = {0: lists[f]}
        for p in range(32):
            if p >> f & 1:
                continue
            if p:
                last = p.bit_length() - 1
                ids = left[p & ~(1 << last)]
                left[p] = ids = ids[~gallop(ids, lists[last])]
            else:
                ids = left[0]
            k = 3 * _AT[f, p]
            for j, some in enumerate((ids, ids[gallop(ids, good)], ids[gallop(ids, toxic)])):
                out[k + j] = np.diff(np.searchsorted(some, border))
    return out


def sizes(postings: DataFrame) -> DataFrame:
    """Per part: rows, and the summed sizes of the 80 differences (plain, good, toxic)."""
    columns = ["part", "first_id", "n_rows", *LISTS]
    n_sizes = 3 * len(PAIRS)

    def run(batches):
        for batch in batches:
            first, rows = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            # Ids of a batch's rows put end to end: ranges that came from different places stay sorted.
            border = np.concatenate([[0], np.cumsum(rows)])
            lists = []
            for k in range(len(LISTS)):
                c = batch.column(3 + k)
                count = np.diff(np.asarray(c.offsets))
                lists.append(np.asarray(c.flatten()) + np.repeat(border[:-1] - first, count))
            found = difference_sizes(lists, border)
            used = found.any(1).nonzero()[0]
            # One row for each part of the batch, with its sizes that are not zero.
            names, code = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            total = np.zeros((names.size, used.size + 1), np.int64)
            np.add.at(total, code, np.concatenate([rows[:, None], found[used].T], 1))
            place = np.concatenate([[n_sizes], used])
            part, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(names[part].tolist(), pa.string()), pa.array(place[j], pa.int32()),
                                              pa.array(total[part, j], pa.int64())], names=["part", "which", "size"])

    each = postings.select(*columns).mapInArrow(run, "part string, which int, size bigint")
    return each.groupBy("part", "which").agg(F.sum("size").alias("size"))


def _step_table():
    """For each order and step: filter, mask of the filters before."""
    out = []
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[k] for k in order), step, f, before))
            before |= 1 << f
    return out


def steps(summed: DataFrame) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    table, n_sizes = _step_table(), 3 * len(PAIRS)
    whole = summed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("which", "size"))).alias("m"))  # at most 241 entries
    counts = ("kept", "removed", "redundant", "unique_fails", *_KINDS[1:], "shapley")

    def run(batches):
        for batch in batches:
            for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = dict(entries)
                at = lambda f, p, j=0: m.get(3 * _AT[f, p] + j, 0)
                every = [at(f, 31 & ~(1 << f)) for f in range(5)]
                shapley = [0] * 5
                for _, _, f, p in table:
                    shapley[f] += at(f, p)
                rows, kept = [], 0
                for _, step, f, p in table:
                    kept = (m[n_sizes] if step == 1 else kept) - at(f, p)
                    rows.append((kept, at(f, p), at(f, 0) - at(f, p), every[f], at(f, p, 1), at(f, p, 2), shapley[f]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(table)), pa.array([t[0] for t in table]), pa.array([t[1] for t in table], pa.int32()),
                     *[pa.array(list(c), pa.int64()) for c in zip(*rows)]], names=["part", "filter_order", "step", *counts])

    return whole.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counts))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all orders of the five filters, for every part of ``docs``."""
    rows = materialise(failures(docs), "audit-failures")
    postings = materialise(posting_lists(with_labels(with_copies(rows), labels)), "audit-postings")
    return steps(sizes(postings))


def oracle() -> str:
    """DuckDB SQL for ``audit``: filters by regular expressions, every step counted from the patterns of failures."""
    names = "".join(f"WHEN {k} THEN '{c}' " for k, c in enumerate(FILTERS))
    order = " || ".join(f"CASE {c} {names}END" for c in "abcde")
    step = "\n  UNION ALL ".join(
        f"SELECT {order}, {k + 1}, {c}, {' + '.join(['0', *[f'(1 << {x})' for x in 'abcde'[:k]]])} FROM orders"
        for k, c in enumerate("abcde"))
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < {MIN_WORDS} THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER_PERCENT} * len(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN first < w.doc_id THEN 16 ELSE 0 END AS fails
      FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
k AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
orders AS (SELECT v.k AS a, w.k AS b, x.k AS c, y.k AS d, 10 - v.k - w.k - x.k - y.k AS e FROM k v, k w, k x, k y
           WHERE v.k <> w.k AND v.k <> x.k AND v.k <> y.k AND w.k <> x.k AND w.k <> y.k AND x.k <> y.k),
s(filter_order, step, f, before) AS ({step}),
r AS (SELECT part, filter_order, step, f,
        sum(CASE WHEN fails & before = 0 AND fails & (1 << f) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN fails & before = 0 AND fails & (1 << f) <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails & before <> 0 AND fails & (1 << f) <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = (1 << f) THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails & before = 0 AND fails & (1 << f) <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN fails & before = 0 AND fails & (1 << f) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM g, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r"""
