import hashlib
import random

import pytest

from tessera.llm import suffixes as S
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(rows, w=200):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - w + 1):
            k = hashlib.blake2b(t[i:i + w], digest_size=16).digest()
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if seen[hashlib.blake2b(t[i:i + w], digest_size=16).digest()] > 1:
                gone[i:i + w] = b"\1" * w
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op4_suffix_array_dedup"](spark, SMALL).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("w", [1, 2, 20, 200])
def test_random_copies(spark, w):
    rng = random.Random(w)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 3 * w))) for _ in range(40)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) + "xyz"[i % 3]) for i in range(60)]
    got = S.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_bytes=w).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, w)


def test_edges_and_cut(spark, doc_rows):
    rows = [tuple(r) for r in doc_rows.select("doc_id", "text").collect()]
    want = brute(rows)
    assert sorted((tuple(r) for r in S.digest(doc_rows).collect()), key=str) == want
    kept = S.cut_repeats(doc_rows)
    assert kept.columns == doc_rows.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[3] is None and texts[1] == "" and texts[10] == "one" and texts[9] == ""
    assert S.digest(doc_rows.limit(0)).count() == 0


def test_a_passage_in_many_packs_gathers_in_no_bucket(spark, monkeypatch):
    """A passage of 70 bytes with another neighbourhood in each document: its blocks spread, its name comes once a pack."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(70)
    rows = [(i, "".join(noise(100) + passage for _ in range(100))) for i in range(60)]
    rows += [(100 + i, rows[i][1][200:900]) for i in range(5)]
    monkeypatch.setattr(S, "PACK_BYTES", 1 << 14)
    sent, own = [], S._round

    def seen(packs, tasks, make, width, *how):
        def count(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    names, more = make(row)
                    if len(names):
                        yield S._sent(row["pack"], names, S.LEAST_BUCKETS, S.np.dtype(width), more)
        sent.append(packs.mapInArrow(count, S.SENT).groupBy("bucket").agg(S.F.sum(S.F.length("names")).alias("n")).cache())
        sent[-1].count()
        return own(packs, tasks, make, width, *how)

    monkeypatch.setattr(S, "_round", seen)
    got = S.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    for frame in sent[1:]:
        sizes = [r["n"] for r in frame.collect()]
        assert max(sizes) < sum(sizes) / 8 or sum(sizes) < 4096, (max(sizes), sum(sizes))


def test_difference_covers():
    for v in [1, 2, 3, 7, 13, 66, 133]:
        d = S.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))
