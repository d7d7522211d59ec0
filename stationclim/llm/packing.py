"""Best-fit packing: conflict-constrained best-fit.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces go, the
longest first, into the fullest bin that still has room (best fit).  Every
bin carries two bitmaps: the sources and the duplicate clusters it holds.  A
bin that already has the piece's source or cluster conflicts with it; the
search then goes to the bin's successor in residual order, until the tightest
compatible bin is found, or a new bin is opened.

Pieces are dealt by a hash into blocks of about ``BLOCK_ROWS`` rows, and
each block is packed by one task on rows without text.  Deal and block count
follow the number of rows, so that a source or a cluster that holds a third
of all rows is spread over all blocks and no task grows with the data.  The
bits of the bitmaps are dense within a block, so they are exact.

A block leaves some bins half empty that another block's pieces could fill.  The
pieces of bins below ``FULL`` of the capacity are therefore dealt and packed a
second time, among one another, in blocks of the same size that hold the loose
ends of many first blocks; ``fill`` gives the figures.

Defined results: null or empty text has no token and takes one piece of
length 0; null source is a source of its own; documents with equal texts are
one cluster unless a ``cluster`` column is given, and null clusters conflict
with nothing but themselves being empty; pieces of one document share its
cluster, so they lie in different bins; ties go by hash, doc_id and piece;
repeated rows are each packed; an empty table gives no rows; extra columns
are dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 4096      # tokens (words) of a bin
BLOCK_ROWS = 4_000   # pieces of a block, in expectation
FULL = 0.9           # bins filled less are taken apart and packed once more

SCHEMA = ("block long, bin long, slot int, offset int, doc_id long, piece int, start int, n_tokens int, "
          "source string, cluster long")


def token_length(text: Column) -> Column:
    """Words separated by blanks, tabs and line ends."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each (length, source bit, cluster bit), taken in the given order.

    ``order`` holds (residual, bin) ascending, so the successor of a bin is
    the next looser one.
    """
    order: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        s_bit, c_bit = 1 << source, 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not (sources[b] & s_bit or clusters[b] & c_bit):
                break
            at += 1
        if at < len(order):
            left, b = order.pop(at)
            sources[b] |= s_bit
            clusters[b] |= c_bit
            insort(order, (left - size, b))
        else:
            b = len(sources)
            sources.append(s_bit)
            clusters.append(c_bit)
            insort(order, (capacity - size, b))
        out.append(b)
    return out


def _pack_block(capacity: int):
    def run(key, rows):
        import pandas as pd

        pieces = sorted(
            (-int(n), rank, -1 if pd.isna(doc) else int(doc), int(piece), int(start), doc, None if pd.isna(source) else source, int(cluster))
            for doc, rank, source, cluster, piece, start, n in zip(
                rows.doc_id, rows["rank"], rows.source, rows.cluster, rows.piece, rows.start, rows.n_tokens))
        bit: dict[tuple[str, object], int] = {}
        dense = lambda kind, v: bit.setdefault((kind, v), len(bit))
        bins = best_fit([(-p[0], dense("s", p[6]), dense("c", p[7])) for p in pieces], capacity)
        total = [0] * (max(bins, default=-1) + 1)
        for p, b in zip(pieces, bins):
            total[b] -= p[0]
        used: dict[int, tuple[int, int]] = {}
        out = []
        for p, b in zip(pieces, bins):
            slot, offset = used.get(b, (0, 0))
            used[b] = (slot + 1, offset - p[0])
            out.append((key[0], b, slot, offset, p[5], p[3], p[4], -p[0], p[6], p[7], p[1], total[b]))
        f = pd.DataFrame(out, columns=[c.split()[0] for c in _PACKED.split(", ")])
        f["doc_id"] = f["doc_id"].astype("Int64")
        return f

    return run


_PACKED = SCHEMA + ", rank long, filled long"


def _deal(pieces: DataFrame, capacity: int, block_rows: int, first: int, name: str) -> tuple[DataFrame, int]:
    """``pieces`` packed in blocks numbered from ``first`` on, and the next free number."""
    blocks = max(1, -(-pieces.count() // block_rows))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("rank", "piece", F.lit(name)), F.lit(blocks)) + F.lit(first))
    return dealt.groupBy("block").applyInPandas(_pack_block(capacity), _PACKED), first + blocks


def pack(docs: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, cluster: Column | None = None,
         full: float = FULL) -> DataFrame:
    """One row per piece: block, bin (unique in its block), slot and offset in the bin, doc_id, piece, start, n_tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.xxhash64(text) if cluster is None else cluster.cast("long")).alias("cluster"), token_length(text).alias("n"))
    # The deal is a hash of the document's id and text, and of a place in its partition for repeated rows.
    ranked = narrow.withColumn("rank", F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()))
    last = F.greatest(F.col("n") - 1, F.lit(0))
    cut = ranked.withColumn("cluster", F.coalesce("cluster", F.col("rank"))).withColumn(
        "start", F.explode(F.sequence(F.lit(0), last, F.lit(capacity))))
    pieces = materialise(cut.select("doc_id", "source", "cluster", "rank", F.floor(F.col("start") / capacity).cast("int").alias("piece"), "start",
                                    F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("int").alias("n_tokens")), "pack-rows")
    packed, following = _deal(pieces, capacity, block_rows, 0, "first")
    packed = materialise(packed, "pack-first")
    loose = packed.where(F.col("filled") < full * capacity).select(*pieces.columns)
    again, _ = _deal(loose, capacity, block_rows, following, "again")
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return packed.where(F.col("filled") >= full * capacity).select(*columns).unionByName(again.select(*columns))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, float]:
    """Bins of a ``pack`` result, and the share of their room that holds tokens."""
    r = packed.agg(F.count_distinct("block", "bin").alias("bins"), F.sum("n_tokens").alias("n")).first()
    return r["bins"], (r["n"] or 0) / max(1, r["bins"] * capacity)
