"""Sharding: balanced label propagation.

Linked documents (here: equal texts) should share a shard, while all shards
keep the same number of rows.  Links are kept as (document, hub): every
document of a group is linked with the group's hub, so a group of ``n`` needs
``n`` rows and no pairs.

1. Every document starts in the shard its hash names.
2. Propagation, in rounds of joins.  Each hub counts its members' shards; each
   document adds up the counts of its hubs and wants the shard with the most of
   its neighbours (ties: an order of the shards that its largest hub names, so
   that neighbours agree).  Documents with one wish and one largest hub move
   together, the largest group first; a group that a shard refuses for lack of
   room takes its next best shard.  Rounds go on until no more links become
   whole; a round that cuts as many links or more is taken back.
3. Sizes are made even: within a shard linked documents rank before unlinked
   ones, group by group.  What ranks beyond the shard's quota goes to the
   shards that lack rows, so unlinked documents move first and at most the
   group at the edge is cut.

The law is ``rows``: the shards' row counts differ by at most one.  A group
larger than a quota (less 1/16, for parts differ in size) is cut into the least
number of such parts, which propagate on their own, since no shard could hold it.

Ranks are exact and distributed: rows are numbered within small cells (a range
of hashes, and for large groups a salt), and cells are summed up per shard.
Only the counts of the shards, and a bounded number of sizes of large hubs and
ranges, reach the driver.  DataFrame functions only.

Defined results: null text has size 8 and crc32 0 and is an (equal) text of
its own; null doc_id and repeated rows are rows like any other; ties go by
hash, then by row id; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

SHARDS = 24
ROUNDS = 8           # at most; rounds end when no more links become whole
HOT_SHARE = 1_000    # a group with more than this part of all rows is joined by a broadcast
CELL_ROWS = 4_000    # rows numbered by one window partition, in expectation
MOVE_RANGES = 256    # hash ranges of a shard by which small hubs are placed; a hub larger than such a part of a quota is large


def _fraction(h: Column) -> Column:
    """A hash as a number from 0 to 1, in the hash's order."""
    return h.cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)


def _shard_counts(df: DataFrame, column: str, shards: int) -> list[int]:
    """Rows per shard: at most ``shards`` numbers reach the driver."""
    found = {r[0]: r[1] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def _pick(index: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def _decide(items: list[tuple[int, list[int]]], wish: list[int], quotas: list[int]) -> list[int]:
    """A shard for each group (size, members in each shard).

    A group that is whole where it wishes to be stays there.  The others follow,
    the largest first, each to the shard it wishes if that has room for it, else
    to the shard with most of its members among those with room (the emptiest
    where none has).  Members of groups that are still to be placed hold no room,
    and neither do unlinked documents: they make way.
    """
    room, out = list(quotas), [0] * len(items)
    whole = [held[w] == size for (size, held), w in zip(items, wish)]
    for k in sorted(range(len(items)), key=lambda k: (not whole[k], -items[k][0], k)):
        size, held = items[k]
        fits = [s for s in range(len(room)) if size <= room[s]]
        if whole[k] or wish[k] in fits:
            out[k] = wish[k]
        elif fits:
            out[k] = max(fits, key=lambda s: (held[s], room[s], -s))
        else:
            out[k] = max(range(len(room)), key=lambda s: (room[s], -s))
        room[out[k]] -= size
    return out


def _hub_votes(links: DataFrame, state: DataFrame, shards: int) -> DataFrame:
    """(hub, size, votes): members of each hub, and how many are in each shard."""
    votes = [F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)]
    return links.join(state, "rid").groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.array(*votes).alias("votes"))


def cut_links(hubs: DataFrame) -> int:
    """Links (document, hub) whose document is not where most of the hub's members are."""
    return hubs.agg(F.coalesce(F.sum(F.col("size") - F.array_max("votes")), F.lit(0))).first()[0]


def propagate(state: DataFrame, links: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """``state`` (rid, shard) of the linked documents after propagation over ``links`` (rid, hub), and the cut links.

    A document may have several hubs.  The list starts with the links that are
    cut before the first round and goes on with those after each round.
    """
    shards = len(quotas)
    hubs = materialise(_hub_votes(links, state, shards), "shard-hubs")
    cuts = [cut_links(hubs)]
    for _ in range(rounds):
        if not cuts[-1]:
            break
        moved = materialise(_round(state, links, hubs, quotas), "shard-state")
        after = materialise(_hub_votes(links, moved, shards), "shard-hubs")
        cut = cut_links(after)
        if cut >= cuts[-1]:
            break
        state, hubs = moved, after
        cuts.append(cut)
    return state, cuts


def _round(state: DataFrame, links: DataFrame, hubs: DataFrame, quotas: list[int]) -> DataFrame:
    """``state`` after one round."""
    spark, shards = links.sparkSession, len(quotas)
    large = F.col("size") * MOVE_RANGES > max(quotas, default=0)
    told = hubs.select("hub", "size", "votes", large.alias("large"), F.when(large, F.col("hub")).otherwise(
        F.floor(_fraction(F.xxhash64("hub", F.lit("place"))) * MOVE_RANGES)).alias("item"))
    # Large hubs are broadcast, so that no task gets one's links: at most shards x MOVE_RANGES for each hub of a document.
    big = told.where("large").withColumnRenamed("hub", "of")
    heard = links.join(F.broadcast(big), F.col("hub") == F.col("of"), "left").drop("of")
    rest = heard.where("size IS NULL").select("rid", "hub").join(told.where("not large"), "hub")
    heard = heard.where("size IS NOT NULL").select(*rest.columns).unionByName(rest)
    pull = heard.groupBy("rid").agg(F.max(F.struct("size", "hub", "large", "item")).alias("lead"),
                                    *[F.sum(F.col("votes")[s]).alias(f"p{s}") for s in range(shards)])
    turn = F.pmod(F.xxhash64("lead.hub", F.lit("turn")), F.lit(shards)).cast("int")
    best = F.array_max(F.array(*[F.struct(F.col(f"p{s}").alias("p"), F.pmod(turn + s, F.lit(shards)).alias("o"), F.lit(s).alias("s"))
                                 for s in range(shards)]))
    wishes = materialise(pull.join(state, "rid").select("rid", "shard", F.col("lead.large").alias("large"), F.col("lead.item").alias("item"),
                                                        best["s"].alias("wish")), "shard-wishes")
    key = ["wish", "large", "item"]
    held = [F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)]
    groups = wishes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array(*held).alias("held")).orderBy(*key).collect()
    at = _decide([(g["n"], g["held"]) for g in groups], [g["wish"] for g in groups], quotas)
    decided = spark.createDataFrame([(g["wish"], g["large"], g["item"], s) for g, s in zip(groups, at)],
                                    "wish int, large boolean, item bigint, at int")  # as bounded as the groups
    return wishes.join(F.broadcast(decided), key).select("rid", F.col("at").alias("shard"))


def shards(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null)."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = materialise(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id"),
        (F.octet_length(data).cast("long") + 8).alias("size"), F.crc32(data).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.sha2(data, 256)).alias("group")), "shard-rows")
    total = rows.count()
    quotas = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    start = F.pmod(F.xxhash64("rid", F.lit("shard")), F.lit(n_shards)).cast("int")

    sizes = materialise(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "shard-sizes")
    hot = F.broadcast(sizes.where(F.col("n") * HOT_SHARE > total))  # fewer than HOT_SHARE rows
    cold = sizes.where(F.col("n") * HOT_SHARE <= total)
    named = rows.select("rid", "group")
    grouped = named.join(hot, "group").unionByName(named.join(hot, "group", "left_anti").join(cold, "group"))
    most = max(1, total // n_shards * 15 // 16)
    part = F.pmod(F.xxhash64("rid", F.lit("part")), F.ceil(F.col("n") / most))
    links = materialise(grouped.select(
        "rid", F.xxhash64("group", part).alias("hub"), F.least("n", F.lit(most)).alias("n")), "shard-links")
    state, _ = propagate(links.select("rid", start.alias("shard")), links.select("rid", "hub"), quotas, rounds)

    linked = links.join(state.withColumnRenamed("shard", "at"), "rid")
    cells = max(1, total // (n_shards * CELL_ROWS))
    every = rows.join(linked, "rid", "left").select(
        "rid", "doc_id", "size", "text_crc32", F.coalesce("at", start).alias("home"), F.col("hub").isNull().alias("free"),
        F.when(F.col("hub").isNull(), F.xxhash64("rid")).otherwise(F.xxhash64("hub", F.lit("rank"))).alias("h"),
        F.when(F.col("hub").isNull(), 0).otherwise(
            F.pmod(F.xxhash64("rid", F.lit("salt")), F.ceil(F.col("n") / CELL_ROWS))).alias("salt"))
    every = materialise(every.withColumn("range", F.floor(_fraction(F.col("h")) * cells)), "shard-homes")

    cell = ["home", "free", "range", "salt"]
    before = Window.partitionBy("home").orderBy("free", "range", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = every.groupBy(*cell).agg(F.count(F.lit(1)).alias("k")).select(
        *cell, (F.sum("k").over(before) - F.col("k")).alias("k0"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("h", "rid")) - 1
    ranked = every.withColumn("r", rank.cast("long")).join(counts, cell).withColumn("rank", F.col("k0") + F.col("r"))

    held = _shard_counts(every, "home", n_shards)
    over = [max(0, c - q) for c, q in zip(held, quotas)]
    lack = [max(0, q - c) for c, q in zip(held, quotas)]
    over_before = [sum(over[:s]) for s in range(n_shards)]
    lack_before = [sum(lack[:s]) for s in range(n_shards)]
    surplus = F.col("rank") >= _pick(F.col("home"), quotas)
    index = _pick(F.col("home"), over_before) + F.col("rank") - _pick(F.col("home"), quotas)
    target = F.lit(0)
    for s in range(n_shards):
        target = F.when(index >= lack_before[s], F.lit(s)).otherwise(target) if lack[s] else target
    shard = F.when(surplus, target).otherwise(F.col("home")).cast("int")
    slot = F.when(surplus, _pick(target, held) + index - _pick(target, lack_before)).otherwise(F.col("rank"))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
                         slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
