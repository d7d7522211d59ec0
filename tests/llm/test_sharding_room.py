"""Sharding: every group is gathered, also when the shard it wants has no room for it."""

from __future__ import annotations

import random
from collections import defaultdict

from stationclim.llm import sharding


def test_refused_hubs_take_another_shard():
    # Three groups want shard 0; the second does not fit beside the first, the third does.
    assert sharding._decide([(6, [5, 1, 0]), (5, [3, 0, 2]), (4, [2, 1, 1])], [0, 0, 0], [10, 10, 10]) == [0, 2, 0]
    # A group that is whole stays before larger ones move.
    assert sharding._decide([(6, [5, 1, 0]), (5, [5, 0, 0])], [0, 0], [10, 10, 10]) == [1, 0]


def model_round(state, links, quotas, turn):
    """One round in plain Python; every hub is large."""
    shards = len(quotas)
    votes = {h: [0] * shards for _, h in links}
    for r, h in links:
        votes[h][state[r]] += 1
    hubs = defaultdict(list)
    for r, h in links:
        hubs[r].append(h)
    groups = defaultdict(list)
    for r, hs in hubs.items():
        lead = max((sum(votes[h]), h) for h in hs)[1]
        pull = [sum(votes[h][s] for h in hs) for s in range(shards)]
        wish = max(range(shards), key=lambda s: (pull[s], (turn[lead] + s) % shards))
        groups[wish, lead].append(r)
    order = sorted(groups)
    items = [(len(groups[k]), [sum(state[r] == s for r in groups[k]) for s in range(shards)]) for k in order]
    out = dict(state)
    for k, at in zip(order, sharding._decide(items, [w for w, _ in order], quotas)):
        out |= {r: at for r in groups[k]}
    return out


def cut(state, links):
    by = defaultdict(list)
    for r, h in links:
        by[h].append(state[r])
    return sum(len(v) - max(v.count(s) for s in v) for v in by.values())


def test_rounds_equal_a_plain_model_and_cut_fewer_links_each_time(spark):
    """Overlapping link sets: chains of hubs that share documents."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    n, shards = 360, 6
    links = sorted({(r, 1000 + (r // 6 + d) % 60) for r in range(n) for d in (0, 1)[:1 + (r % 3 == 0)]} | {(r, 2000 + r % 4) for r in range(0, n, 15)})
    start = {r: rng.randrange(shards) for r in range(n)}
    quotas = [n // shards] * shards
    hubs = sorted({h for _, h in links})
    turn = {r.h: r.t for r in spark.createDataFrame([(h,) for h in hubs], "h bigint").select(
        "h", F.pmod(F.xxhash64("h", F.lit("turn")), F.lit(shards)).alias("t")).collect()}
    frame = spark.createDataFrame(links, "rid bigint, hub bigint").repartition(5)
    state = spark.createDataFrame(sorted(start.items()), "rid bigint, shard int")
    want, cuts = start, [cut(start, links)]
    for _ in range(sharding.ROUNDS):
        after = model_round(want, links, quotas, turn)
        if cut(after, links) >= cuts[-1]:
            break
        want = after
        cuts.append(cut(after, links))
    got, found = sharding.propagate(state, frame, quotas)
    assert {r.rid: r.shard for r in got.collect()} == want and found == cuts
    assert len(cuts) >= 3 and cuts == sorted(set(cuts), reverse=True) and cuts[-1] < cuts[0] / 2
    one, _ = sharding.propagate(state, frame, quotas, rounds=1)
    assert {r.rid: r.shard for r in one.collect()} != want  # rounds matter
    none, first = sharding.propagate(state, frame, quotas, rounds=0)
    assert {r.rid: r.shard for r in none.collect()} == start and first == cuts[:1]


def test_no_group_is_left_at_its_hash_homes(docs_of):
    rng = random.Random(3)
    texts = ["hot text"] * 1_000 + [f"pair {i}" for i in range(400)] * 2 + [f"ten {i}" for i in range(40)] * 10 + [f"single {i}" for i in range(800)]
    rng.shuffle(texts)
    n = 12
    got = sharding.shards(docs_of(list(enumerate(texts))), n).collect()
    counts = [sum(r.shard == s for r in got) for s in range(n)]
    assert len(got) == len(texts) and max(counts) - min(counts) <= 1
    where = defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    assert len(where.pop("hot text")) <= 5  # it fills four shards
    assert sum(len(v) - 1 for v in where.values()) <= n  # at most the group at each shard's edge is cut
