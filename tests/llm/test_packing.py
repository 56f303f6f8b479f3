import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing as P
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, capacity=2048):
    t = Tokenizer.from_file(PATH)
    want = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for d, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(want[d])
    padding = total = 0
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    assert padding <= 0.02 * total


def test_query_packs_every_token(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op6_packing"](spark, SMALL).collect(), docs)


def test_edges(spark):
    texts = [None, "", " ", "It's 12½ o'clock, İstanbul ΣΑΣ x²", "tabs\tand\x1fcontrols\x85", "a<|endoftext|>b <|startoftext|>",
             "naïve café — “quotes” 中文 🎉", "word " * 5000, "ÀÉÎ ǅ ŉ", "'s't're've'm'll'd 'S", "___ -- !!"]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(d, t, "old") for d, t in docs], "doc_id long, text string, start string").repartition(2)
    rows = P.pack(frame, PATH, keep_ids=True, block_tokens=4096).collect()
    check(rows, docs)
    t = Tokenizer.from_file(PATH)
    got = b"".join(np.array(r["ids"], dtype="<u4").tobytes() for r in sorted((r for r in rows if r["doc_id"] == 7), key=lambda r: r["start"]))
    assert np.frombuffer(got, dtype="<u4").tolist() == t.encode(texts[7], add_special_tokens=False).ids + [1]
    assert P.pack(frame.limit(0), PATH).count() == 0


def test_plain_characters_agree_with_the_library():
    rng = random.Random(3)
    t, own = Tokenizer.from_file(PATH), P.Tokens(PATH)
    chars = [chr(c) for c in range(9, 0x180)]
    for _ in range(400):
        text = "".join(rng.choice(chars) for _ in range(60))
        assert np.frombuffer(own([text])[0], dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_forgotten_words_and_slices(monkeypatch):
    t, rng = Tokenizer.from_file(PATH), random.Random(4)
    texts = [" ".join("".join(rng.choice("abcé'1.-") for _ in range(rng.choice([1, 3, 6, 90]))) for _ in range(40)) for _ in range(30)]
    monkeypatch.setattr(P, "KEPT_WORDS", 50)
    own = P.Tokens(PATH)
    for lo in range(0, 30, 4):
        for text, ids in zip(texts[lo:lo + 4], own(texts[lo:lo + 4])):
            assert np.frombuffer(ids, dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert max(map(len, own.runs)) <= P.KEPT_LENGTH and len(own.runs) < 300


def test_words_kept_twice_and_calls_of_the_library(monkeypatch):
    """Words met again cost no merge, words of letters are kept once, and no plain text is encoded by the whole library."""
    own, rng = P.Tokens(PATH), random.Random(5)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(50)]
    want = [own.library(t).tobytes() for t in texts]
    merged = []
    merge = own.merge
    own.merge = lambda word: merged.append(word) or merge(word)
    monkeypatch.setattr(own, "library", lambda text: 1 / 0)
    assert own(texts) == want and own(texts) == want
    assert len(merged) == len(set(merged)) == len(set(" ".join(texts).split()))
    assert len(own.runs) == len(merged) and not own.pieces
    assert own([]) == [] and own([""]) == [b""] and own([" ", "\xa0a"])[0] == b""


def brute_assign(sizes, capacities):
    """Largest piece first, to the sequence of lowest cost with room; one that fits nowhere is cut to the largest room."""
    pieces = [(n, i, i, 0) for i, n in enumerate(sizes)]  # size, turn, document, start
    room, load, out, turn = list(capacities), [0.0] * len(capacities), [[] for _ in capacities], len(sizes)
    while pieces and any(room):
        piece = min(pieces, key=lambda p: (-p[0], p[1]))
        pieces.remove(piece)
        n, _, doc, start = piece
        fitting = [k for k in range(len(room)) if room[k] >= n]
        if fitting:
            k = min(fitting, key=lambda k: (load[k], k))
        else:
            k = max(range(len(room)), key=lambda k: (room[k], -k))
            pieces.append((n - room[k], turn, doc, start + room[k]))
            turn, n = turn + 1, room[k]
        out[k].append((doc, start, n))
        room[k] -= n
        load[k] += P.cost(n)
    return out, sorted((d, s, n) for n, _, d, s in pieces)


def test_assignment_equals_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 7, 30, 60, 100, rng.randrange(1, 128)]) for _ in range(rng.randrange(1, 40))]
        capacities = [128] * (sum(sizes) // 128) or [1 << b for b in range(7, -1, -1) if sum(sizes) >> b & 1]
        full, rest = P.assign([P.Piece(i, 0, n, bytes(4 * n), n) for i, n in enumerate(sizes)], capacities)
        got = [[(p.row, p.start, p.n) for p in s] for s in full], sorted((p.row, p.start, p.n) for p in rest)
        assert got == brute_assign(sizes, capacities)
        assert [sum(p.n for p in s) for s in full] == capacities
