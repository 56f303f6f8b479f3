import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment as A
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def al():
    return A.Aligner(*PATHS)


def brute(rows, al):
    """Per row the result's columns, by the libraries and by offsets alone."""
    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    docs, counts = [], Counter()
    for doc, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(al.a.bytes_of[x] for x in a) != want or b"".join(al.b.bytes_of[x] for x in b) != want:
            a, b = [], []
        ends_a = list(accumulate(len(al.a.bytes_of[x]) for x in a))
        ends_b = list(accumulate(len(al.b.bytes_of[x]) for x in b))
        place_a, place_b = ({e: i for i, e in enumerate(x)} for x in (ends_a, ends_b))
        shared = sorted(set(ends_a) & set(ends_b))
        links = [(a[place_a[e]], b[place_b[e]]) for e in shared]
        groups, i, j = [], 0, 0
        for e in shared:
            k, m = place_a[e] + 1, place_b[e] + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        counts.update(links)
        docs.append((doc, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (x, y), n in counts.items():
        top[y] = max(top[y], n)
    return Counter((doc, len(a), len(b), len(links), len(links), sum(counts[p] == top[p[1]] for p in links),
                    sum(counts[p] for p in links), sha) for doc, a, b, links, sha in docs)


def test_query_equals_offsets(spark, al):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(d, t) for d, t in rows]
    got = QUERIES["op13_tokenizer_alignment"](spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows, al)


def test_edges(spark, doc_rows, al):
    odd = [(20, " leading and  double   spaces "), (21, "\n\t tabs and　wide"), (22, "<s> <unk> <|endoftext|> </s>"),
           (23, "日本語 текст 🎉🎉 ½"), (24, " "), (25, "▁ mark"), (26, "▁▁"), (27, "a\x00b"), (28, "ﬁ ligature Å")]
    docs = doc_rows.select("doc_id", "text", doc_rows["lang"].alias("n_a"), doc_rows["source"].alias("link_a")).unionByName(
        spark.createDataFrame([(*r, "x", "y") for r in odd], "doc_id long, text string, n_a string, link_a string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter(map(tuple, A.digest(docs, *PATHS).collect()))
    assert got == brute(rows, al)
    assert got[(3, 0, 0, 0, 0, 0, 0, "")] == 1 and got[(4, 0, 0, 0, 0, 0, 0, "")] == 1
    assert A.digest(docs.limit(0), *PATHS).count() == 0


def test_kept_groups_and_pairs(spark, doc_rows):
    rows = A.aligned(doc_rows, *PATHS).collect()
    for r in rows:
        assert (hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") == r["groups_sha256"]
        assert sum(r["link_n"]) == r["n_links"] == (r["groups"].count(";") + 1 if r["groups"] else 0)


def test_both_libraries_agree_below_0530(al):
    for c in map(chr, range(0x530)):
        text = f" a{c}b {c}{c} 1{c}'s  {c}"
        assert al.a.fast.encode_ordinary(text) == al.a.slow(text)


def test_parts_give_the_same_tokens(al):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é1. \n") for _ in range(300)) for _ in range(50)] + ["x" * 200, " " * 200, "a b " * 50]
    assert al.cuttable
    for text, (n_a, n_b, groups, _) in zip(texts, al(texts)):
        sides = [g.split("|") for g in groups.split(";")]
        a, b = ([int(x) for g in sides for x in g[k].split(",")] for k in (0, 1))
        assert (a, b) == (al.a.slow(" " + text), al.b.encode([text])[0]) and (n_a, n_b) == (len(a), len(b))


def test_forgotten_windows_and_parts_are_aligned_again(al, monkeypatch):
    texts = [f"some words {i} and {i * 7} more " * 3 for i in range(40)]
    whole = al(texts)
    monkeypatch.setattr(A, "KEPT_WINDOWS", 10)
    monkeypatch.setattr(A, "KEPT_PARTS", 10)
    small = A.Aligner(*PATHS)
    assert [small([t])[0] for t in texts] == whole
    assert len(small.parts) <= 20 and len(small.windows) <= 10


def test_pairs_are_bounded_by_the_vocabularies(al):
    assert A.most_pairs([b"ab", b"b"], [b"b", b"xb"]) == 3  # ab-b, b-b, b-xb
    assert 50_000 < A.most_pairs(al.a.bytes_of, al.b.bytes_of) < 1_000_000
