import re

import xxhash

from tessera.llm import simhash as S
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def brute_print(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=2):
    prints = [brute_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for (doc, _), f in zip(rows, prints):
        if doc is not None:
            least[find(f)] = min(doc, least.get(find(f), doc))
    return sorted(((doc, f"{f:016x}", least.get(find(f))) for (doc, _), f in zip(rows, prints)), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op9_simhash_near_dedup"](spark, SMALL).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_edges(spark, doc_rows):
    rows = [tuple(r) for r in doc_rows.select("doc_id", "text").collect()]
    want = brute(rows)
    assert sorted((tuple(r) for r in S.near_duplicates(doc_rows).collect()), key=str) == want
    kept = S.keep_representatives(doc_rows)
    assert kept.columns == doc_rows.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({r[2] for r in want}, key=str)
    assert S.near_duplicates(doc_rows.limit(0)).count() == 0
    assert S.keep_representatives(doc_rows.limit(0)).count() == 0


def test_components_with_one_smallest_id_both_stay(spark):
    texts = ["an apple a day keeps the doctor away they say", "completely different words about trains and rivers in winter"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (1, texts[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in S.keep_representatives(frame).collect()) == [(1, texts[0]), (1, texts[1])]
    assert sorted((tuple(r) for r in S.near_duplicates(frame).collect()), key=str) == brute(rows)


def test_chains_and_covering(spark):
    assert all(any((m >> i | m >> j) & 1 == 0 for m in S.covering_masks(2)) for i in range(64) for j in range(64))
    chain = [0]
    for k in range(30):
        chain.append(chain[-1] ^ (0b11 << (2 * k)))
    far = (1 << 63) | 0x5555
    signed = [S._signed(v) for v in chain + [far]]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r["node"]: r["root"] for r in S.components(S.links(frame)).collect()}
    assert set(got) == set(signed[:-1])
    assert set(got.values()) == {min(signed[:-1])}
