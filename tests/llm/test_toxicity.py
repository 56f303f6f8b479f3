import zlib

import numpy as np

from tessera.llm import toxicity as X
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.1"


def test_query_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = QUERIES["op7_toxicity"](spark, SMALL).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    t, p = np.array(held).T
    recall, clean = p[t == 1].mean(), 1 - p[t == 0].mean()
    print("held-out recall", recall, "clean kept", clean, "share predicted", np.mean([r["predicted"] for r in rows]))
    assert recall > 0.85 and clean > 0.98


def network():
    texts = [(f"the dog runs home {i} and the cat sleeps " + ("you idiot " if i % 2 else "my friend ") + "today").encode() for i in range(80)]
    return X.train(texts, np.arange(80) % 2)


def words(*texts):
    raw = [t.encode() for t in texts]
    return X.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def test_gradients_are_those_of_the_loss():
    w = words("a bad idea was had by all of them here", "good dog " * 30)
    net = X.Network(w.hashes[:5], np.ones(5))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    net.p["att"] = rng.normal(size=2 * X.HIDDEN)
    x, rows, y = net.inputs(w), w.windows()[0], np.array([1.0, 0, 0, 1])
    assert len(rows) == 4

    def loss():
        p = X._sigmoid(net.logits(x, rows).astype(np.float64))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    g, d_x = net.gradients(x, rows, y)
    for k in ("out", "bias", "att", "wf", "ub", "cf", "uf", "cb"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old, eps = net.p[k][at], 1e-2
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        assert abs((up - loss()) / (2 * eps) - g[k][at]) < 2e-3, k
        net.p[k][at] = old


def test_windows_cover_every_word():
    w = words("", "one", "w " * 32, "w " * 33, " ".join(map(str, range(100))))
    rows, first = w.windows()
    assert np.diff(first).tolist() == [0, 1, 1, 2, 4]
    last = rows[first[4]:]
    assert set(last.ravel()) == set(w.which[w.first[4]:])


def test_finds_the_word_anywhere(spark):
    net = network()
    texts = ["filler " * n + "you idiot " + "filler " * m for n, m in ((0, 0), (31, 2), (500, 700), (23, 9))]
    assert (net.scores(words(*texts)) >= 0.5).all()
    assert (net.scores(words("the dog and my friend sleeps today", "", "?!")) < 0.5).all()
    assert net.scores(words("", "?!")).tolist() == [0, 0]


def test_edges(spark, doc_rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (8, 0, 0), (9, 1, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = X.toxicity(doc_rows, labels).collect()
    assert len(rows) == doc_rows.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in X.toxicity(doc_rows, labels.limit(0)).collect()} == {0.0}
    assert X.toxicity(doc_rows.limit(0), labels).count() == 0
