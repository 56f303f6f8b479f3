import random
import zlib

import numpy as np

from tessera.llm import sharding as S
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def brute_capacity(sizes, shards):
    """Smallest maximum over all contiguous partitions (dynamic program)."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = [float("inf")] * (len(sizes) + 1)
    best[0] = 0
    for _ in range(shards):
        best = [min(max(best[j], total[i] - total[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


def test_smallest_capacity_and_cuts():
    rng = random.Random(1)
    for _ in range(60):
        sizes = np.array([rng.choice([1, 2, 9, 50]) for _ in range(rng.randint(1, 25))])
        for shards in (1, 3, 5):
            cap = S.smallest_capacity(sizes, shards)
            assert cap == brute_capacity(sizes.tolist(), shards)
            ends = S.balanced_cuts(sizes, cap, shards)
            parts = [sizes[a:b].sum() for a, b in zip([0, *ends[:-1]], ends)]
            assert ends[-1] == len(sizes) and max(parts) <= cap


def test_bins_give_the_capacity_of_the_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "BIN_BITS", 3)
    monkeypatch.setattr(S, "SPLIT_BITS", 2)
    rng = random.Random(5)
    for n, hot in ((300, 0), (300, 9000), (5, 0)):
        rows = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(20), rng.randint(1, 60)) for _ in range(n)]
        if hot:
            rows[7] = (*rows[7][:2], hot)
        rows.append((rows[0][0], rows[0][1] + 1, 10))  # same first key
        frame = spark.createDataFrame(rows, "k1 long, k2 long, bytes long").cache()
        cuts, cap = S.cut_keys(frame, 4)
        sizes = np.array([r[2] for r in sorted(rows)])
        assert cap == S.smallest_capacity(sizes, 4)
        got = [0] * 4
        for k1, k2, b in rows:
            got[sum((k1, k2) >= (c1, -1 << 63 if c2 is None else c2) for c1, c2 in cuts)] += b
        assert max(got) <= cap


def check(rows, docs):
    size = {}
    for r in rows:
        text = docs[r["doc_id"]]
        raw = (text or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    groups = {}
    for r in rows:
        groups.setdefault(docs[r["doc_id"]] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    for s in size:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert set(size) <= set(range(16))
    return size


def test_query(spark):
    docs = dict(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    rows = QUERIES["op10_sharding"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    size = check(rows, docs)
    assert len(size) == 16 and max(size.values()) < 1.25 * sum(size.values()) / 16


def test_edges(spark, doc_rows):
    rows = S.shard(doc_rows).collect()
    assert len(rows) == doc_rows.count()
    check(rows, {r["doc_id"]: r["text"] for r in doc_rows.collect()})
    assert S.shard(doc_rows.limit(0)).count() == 0
