"""Benchmark decontamination: prefix-filtered set join.

Every item is cut into windows of ``WINDOW`` consecutive words (an item of
fewer words is one window).  A window can only occur where all its words do,
so its *prefix* under a rarity order is one necessary word: the one that is
rarest in the whole corpus.  Documents' words are joined with the prefix
words; a match proposes a place for the window, the length and position
bounds discard places that stick out of the text, and the remaining places
are verified word by word.

The corpus counts that order the words are taken over all documents, for the
words of the benchmark only.  The windows are joined in blocks of at most
``BLOCK_WINDOWS``; each block is broadcast, and documents never leave their
task.  With more than one block the hit words of a document are merged by
its row id.

Defined results: null or empty text has no words and is clean; a null item
text has no window; windows of an item with a null id mark words, but the id
is neither listed nor counted; equal item ids count once; repeated documents
are each answered; an empty benchmark leaves every document clean; extra
columns are kept by ``remove_contaminated`` and dropped by ``hits``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, materialise

WINDOW = 10
BLOCK_WINDOWS = 200_000  # windows broadcast at once, about 20 MB

_LETTERS = bytes(range(0x41, 0x5B))
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_LETTERS + _SEPARATORS, _LETTERS.lower() + b" " * len(_SEPARATORS))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list, size: int) -> list[tuple]:
    if not words:
        return []
    if len(words) < size:
        return [tuple(words)]
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(w, item_ids) of every distinct window, its words joined by a blank."""

    def cut(batches):
        for b in batches:
            ids, wins = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {b" ".join(w).decode("utf-8", "surrogatepass") for w in windows_of(words_of(t), size)}
                ids += [i] * len(found)
                wins += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.string())], names=["id", "w"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "id string, w string").groupBy("w").agg(F.array_sort(F.collect_set("id")).alias("item_ids"))


def corpus_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each benchmark word occurs in all documents.

    The vocabulary is broadcast in one piece only up to ``BLOCK_WINDOWS``
    words; a larger one is counted by a plain join of exploded words.
    """
    vocab = vocabulary.select("word").distinct()
    if vocab.count() > BLOCK_WINDOWS:
        every = docs.select(F.explode(F.split(F.regexp_replace(
            F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ")).alias("word"))
        return every.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocab, "word", "left_semi")
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r.word.encode("utf-8", "surrogatepass") for r in vocab.collect()))

    def count(batches):
        seen: dict[bytes, int] = defaultdict(int)
        keep = wanted.value
        for b in batches:
            for t in b.column(0):
                for w in words_of(t.as_py()):
                    if w in keep:
                        seen[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode("utf-8", "surrogatepass") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["word", "n"])

    part = docs.select(F.col(text).cast("string")).mapInArrow(count, "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its prefix: the rarest word (ties: the smaller word), and the word's first place."""
    words = windows.select("w", F.posexplode(F.split("w", " ")).alias("at", "word"))
    ranked = words.join(counts, "word", "left").groupBy("w").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p"))
    return windows.join(ranked, "w").select("w", "item_ids", F.col("p.word").alias("prefix"), F.col("p.at").alias("at"))


def _index(rows) -> dict[bytes, list]:
    """prefix word -> [(place of the prefix, words of the window, item ids)]."""
    out: dict[bytes, list] = defaultdict(list)
    for r in rows:
        words = r.w.encode("utf-8", "surrogatepass").split(b" ")
        out[r.prefix.encode("utf-8", "surrogatepass")].append((r.at, words, list(r.item_ids)))
    return dict(out)


def find(words: list[bytes], index: dict[bytes, list]) -> tuple[set[int], set[str]]:
    """Hit word positions and ids of items with a window in the text."""
    hit: set[int] = set()
    items: set[str] = set()
    n = len(words)
    if index.keys().isdisjoint(words):
        return hit, items
    for p, w in enumerate(words):
        if w in index:
            for at, window, ids in index[w]:
                start, size = p - at, len(window)
                if start >= 0 and start + size <= n and words[start:start + size] == window:
                    hit.update(range(start, start + size))
                    items.update(ids)
    return hit, items


def _blocks(benchmark: DataFrame, docs: DataFrame, size: int, block_windows: int):
    """Broadcast indexes of all windows, at most ``block_windows`` each."""
    spark = docs.sparkSession
    windows = materialise(item_windows(benchmark, size), "bench-windows")
    vocab = windows.select(F.explode(F.split("w", " ")).alias("word"))
    joined = materialise(prefixes(windows, corpus_counts(docs, vocab)), "bench-prefixes")
    n = -(-joined.count() // block_windows) or 1
    # Blocks of equal size in expectation: windows are dealt by their hash.
    for k in range(n):
        part = joined.where(F.pmod(F.xxhash64("w"), F.lit(n)) == k) if n > 1 else joined
        yield n, spark.sparkContext.broadcast(_index(part.toLocalIterator()))


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())),
          T.StructField("items", T.ArrayType(T.StringType()))]


def _finder(index):
    def make(texts: pa.Array) -> list[pa.Array]:
        n, hits, items = [], [], []
        for t in texts:
            words = words_of(t.as_py())
            h, i = find(words, index.value)
            n.append(len(words))
            hits.append(sorted(h))
            items.append(sorted(i))
        return [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

    return make


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, hit (sorted word positions), items (sorted ids, as text)."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = []
    for n, index in _blocks(benchmark, docs, size, block_windows):
        if n > 1 and not parts:
            narrow = materialise(narrow.withColumn("rid", F.monotonically_increasing_id()), "bench-docs")
        found, _ = append_columns(narrow, F.col("text"), FIELDS, _finder(index))
        parts.append(found.drop("text"))
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", "hit", "items")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("rid")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                        block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents in which no window of any item occurs, with their own columns."""
    out = docs
    for _, index in _blocks(benchmark, docs, size, block_windows):
        found, names = append_columns(out, F.col("text"), FIELDS, _finder(index))
        out = found.where(F.size(names[1]) == 0).select(*docs.columns)
    return out


def hash_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


# DuckDB: every run of words of a document that equals a window of an item.
ORACLE = r"""
with d as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (
  select distinct item_id, least(len(ws), 10) as k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as w
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as i from b where len(ws) > 0)),
ks as (select distinct k from bw),
dw as (
  select rid, k, i, array_to_string(ws[i:i + k - 1], ' ') as w
  from (select rid, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, ks where len(ws) >= k)),
m as (select rid, i, dw.k, item_id from dw join bw on dw.w = bw.w and dw.k = bw.k),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from m) group by rid),
t as (
  select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct rid, item_id from m where item_id is not null) group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (rid) left join t using (rid)
"""
