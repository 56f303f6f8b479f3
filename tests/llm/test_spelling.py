import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import spelling
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def near(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute(vocabulary):
    """word -> (form, root, n, n_near, form_n), by comparing all pairs."""
    beside = {w: [] for w in vocabulary}
    by_length = {}
    for w in vocabulary:
        by_length.setdefault(len(w), []).append(w)
    for w in vocabulary:
        for k in (len(w) - 1, len(w), len(w) + 1):
            beside[w] += [v for v in by_length.get(k, []) if near(w, v)]
    form = {}
    for w, n in vocabulary.items():
        best = min(((-vocabulary[v], v) for v in beside[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
    out = {}
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(beside[w]), vocabulary[form[w]] if form[w] else None)
    return out


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def as_dict(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("list_words", [20_000, 3])
def test_groups_equal_all_pairs(spark, list_words):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([5, 5, 6, 6, 7, 8, 9, 12]))): rng.choice([3, 4, 6, 8, 12, 50, 100])
             for _ in range(900)}
    words |= {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 14)}  # a path of forms
    words |= {"x" * 300 + c: 4 for c in ("", "y", "z", "yz")}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_dict(spelling.groups(df, list_words=list_words)) == brute(words)


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    words = brute_words(rows)
    assert any(n >= 3 for n in words.values())
    assert as_dict(QUERIES["op11_spelling_variants"](spark, SMALL)) == brute(words)


def test_long_lists_are_dealt_again(spark):
    words = spark.createDataFrame([("abcdef" + chr(97 + i) + chr(97 + j), 3) for i in range(26) for j in range(26)], "word string, n long")
    sizes = spelling.lists(words, 100).groupBy(*spelling.KEY).count()
    assert sizes.where("hi - lo > 1").agg({"count": "max"}).first()[0] <= 100
    assert as_dict(spelling.groups(words, list_words=100)) == {w: (None, w, 3, 50, None) for w, _ in words.collect()}


def test_edges(spark, doc_rows):
    rows = [(r["doc_id"], r["text"]) for r in doc_rows.collect()]
    clashing = doc_rows.withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    got = as_dict(spelling.groups(spelling.vocabulary(clashing)))
    assert got == brute(brute_words(rows)) and len(got) > 3
    assert spelling.groups(spelling.vocabulary(doc_rows.limit(0))).count() == 0


def test_slips():
    assert spelling.slipped("abcde", 97 * 6) == "abde" and spelling.slipped("abcde", 98) == "abcde"
