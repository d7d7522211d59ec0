"""The second deal fills what the blocks leave half empty."""

from __future__ import annotations

from stationclim.llm import packing
from stationclim.llm.common import table

SF = "/root/testdata/sf0.1"


def test_second_deal(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source").cache()
    before, share = packing.fill(packing.pack(docs, full=0.0))
    packed = packing.pack(docs).cache()
    after, better = packing.fill(packed)
    assert after < before and better > share and after <= 1_070
    # Every piece is there once, no bin overflows, none holds a source or a cluster twice.
    n = docs.select("doc_id", packing.token_length(docs.text).alias("n")).collect()
    want = {(r.doc_id, s): min(4096, r.n - s) for r in n for s in range(0, max(r.n, 1), 4096)}
    rows = packed.collect()
    assert len(rows) == len(want) and {(r.doc_id, r.start): r.n_tokens for r in rows} == want
    bins: dict = {}
    for r in rows:
        bins.setdefault((r.block, r.bin), []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.slot)
        assert [r.slot for r in held] == list(range(len(held))) and sum(r.n_tokens for r in held) <= 4096
        assert [r.offset for r in held] == [sum(q.n_tokens for q in held[:k]) for k in range(len(held))]
        assert len({r.source for r in held}) == len({r.cluster for r in held}) == len(held)
    print(before, round(share, 4), after, round(better, 4))
