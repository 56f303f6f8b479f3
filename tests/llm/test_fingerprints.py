import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm import fingerprints as P
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def jaccard(a, b):
    a, b = P.terms(a), P.terms(b)
    return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0


def brute(rows):
    """Rows in the order of (id, text), each with its successor."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    sign, out = P.Sampler(), []
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        other = text[:len(text) - half] + following[:half]
        a, b, c = (sign(P.terms(x)) for x in (text, other, following))
        out.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest(), P.to_text(a), P.to_text(b),
                    float((a == b).mean()), float((a == c).mean())))
    return Counter(out)


def test_query_equals_plain_order(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_document_fingerprints"](spark, SMALL).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    text_of = dict(rows)
    of_text = {}
    for r in got:
        assert of_text.setdefault(text_of[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    assert len(set(of_text.values())) > 0.9 * len(of_text)


def test_likeness_estimates_weighted_jaccard():
    rng = random.Random(1)
    sign, errors = P.Sampler(512), []
    for _ in range(60):
        a = Counter({b"%d" % rng.randrange(60): rng.choice([1, 1, 2, 5, 30]) for _ in range(30)})
        b = Counter({t: max(1, n + rng.choice([-2, 0, 0, 9])) for t, n in a.items() if rng.random() < 0.8})
        b[b"%d" % rng.randrange(1000)] += 4
        errors.append((sign(a) == sign(b)).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.1


def test_weight_alone_changes_the_likeness():
    sign = P.Sampler(4096)
    got = (sign({b"a": 2}) == sign({b"a": 6})).mean()
    assert abs(got - 1 / 3) < 0.03


def test_signatures_do_not_depend_on_the_cache():
    texts = ["the cat " * 3 + str(i) for i in range(50)] + [" ".join(f"w{i}" for i in range(500))]
    small, large = P.Sampler(32, kept=20), P.Sampler(32)
    for t in texts:
        assert (small(P.terms(t)) == large(P.terms(t))).all()


def test_terms_of_long_texts(monkeypatch):
    text = "Word ÄB\tx " * 500
    whole = P.terms(text)
    monkeypatch.setattr(P, "PART_CHARS", 7)
    assert P.terms(text) == whole == Counter({b"word": 500, "ÄB".encode().lower(): 500, b"x": 500})


def test_edges(spark, doc_rows):
    clashing = doc_rows.withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "_range")
    rows = [(r["doc_id"], r["text"]) for r in doc_rows.collect()]
    for range_bytes in (1 << 30, 10):
        assert Counter(map(tuple, P.with_successors(clashing, range_bytes=range_bytes).collect())) == brute(rows)
    assert P.with_successors(doc_rows.limit(0)).count() == 0
    alone = P.with_successors(spark.createDataFrame([(1, "a b c d", 0)], "doc_id long, text string, n_chars int")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()[:64]


def test_added_column(spark, doc_rows):
    out = P.fingerprints(doc_rows, samples=16).select("doc_id", "text", "fingerprint").collect()
    assert all(len(r["fingerprint"]) == 64 for r in out)
    assert {r["fingerprint"] for r in out if not r["text"]} == {"0" * 64}
    assert P.likeness(out[0]["fingerprint"], out[1]["fingerprint"]) == 1.0
