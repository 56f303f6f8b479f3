import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import tokencount as C
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_query_equals_library(spark):
    t = Tokenizer.from_file(PATH)
    docs = dict(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    rows = QUERIES["op2_token_counts"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(t.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((docs[r["doc_id"]] or "").encode()), n, n > 1024)


def counts(counter, texts):
    raw = [x.encode() for x in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return counter(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds).tolist()


def test_random_texts_equal_library():
    t, counter, rng = Tokenizer.from_file(PATH), C.Counter(PATH), random.Random(4)
    alphabets = ["'strevmld e", "  \n\ta1!'s", "abcdefghij ", "aé中🎉  　½'", "aaab", "0123456789., "]
    texts = ["", " ", "\n\n", "a<|endoftext|>b", "<|endoftext|><|endoftext|> ", "x  <|endoftext|>  'll", "<|endoftext", "'r", "'l", "''re"]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0xD7FF)])) for _ in range(40)) for _ in range(100)]
    assert counts(counter, texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_long_texts_cross_chunks():
    t, counter, rng = Tokenizer.from_file(PATH), C.Counter(PATH), random.Random(5)
    texts = ["a" * 5000, "ab" * 3000 + "'", " " * 3000 + "x", "x" + " " * 3000, "".join(rng.choice("ab'sl  \n1") for _ in range(9000))]
    assert counts(counter, texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_transitions_add_up():
    t, m = Tokenizer.from_file(PATH), C.Counter(PATH).words
    for w in ("unbelievable", "antidisestablishment", "zzzzzzzz", "internationalization"):
        steps = m.transitions(w.encode())
        assert sum(steps) == len(t.encode(w).ids) and len(steps) == len(w)


def test_edges(spark, doc_rows):
    rows = {r["doc_id"]: r for r in C.count_tokens(doc_rows, PATH).collect()}
    assert (rows[3]["n_bytes"], rows[3]["n_tokens"]) == (0, 0) and rows[4]["n_tokens"] == 0
    assert rows[9]["over_limit"] and not rows[10]["over_limit"]
    assert C.count_tokens(doc_rows.limit(0), PATH).count() == 0


def thue_morse(a, b, n=1024):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_hash_alike_are_counted_apart():
    t, counter = Tokenizer.from_file(PATH), C.Counter(PATH)
    for a, b in ("ab", "at", "an", "er", "in"):
        for n in (1024, 4096):
            texts = [thue_morse(a, b, n), thue_morse(b, a, n), thue_morse(a, b, n)]
            assert counts(counter, texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
