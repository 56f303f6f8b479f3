import numpy as np

from tessera.llm import language as L
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_query_held_out_accuracy(spark):
    import zlib
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op1_language_id"](spark, SMALL).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]
    print(np.mean(right), min(r["score"] for r in rows), sorted(r["score"] for r in rows)[:10])
    assert np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_collapsed_scores_equal_kernel_scores():
    rng = np.random.default_rng(0)
    L_ = L.LANDMARKS
    grams = [np.unique(rng.integers(0, 400, 60)) + 200 * (i % 2) for i in range(60)]
    labels = ["ab"[i % 2] for i in range(60)]
    m = L.Model.fit([97, 98], grams, labels)
    assert (m.score(grams).argmax(axis=1) == np.arange(60) % 2).all()
    # explicit kernels, whitening and ridge, without the collapsed matrix
    sets = [set(g.tolist()) for g in grams]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    order = np.random.default_rng(7).permutation(60)
    c = sorted(order[:L_])
    values, vectors = np.linalg.eigh(k[np.ix_(c, c)])
    keep = values > 1e-6 * values.max()
    x = k[:, c] @ (vectors[:, keep] / np.sqrt(values[keep]))
    y = np.where(np.arange(60)[:, None] % 2 == np.arange(2)[None, :], 1.0, -1.0)
    xc = x - x.mean(0)
    w = np.linalg.solve(xc.T @ xc + L.RIDGE * 60 * np.eye(x.shape[1]) / 100, xc.T @ (y - y.mean(0)))
    assert np.allclose(m.score(grams), xc @ w + y.mean(0), atol=1e-3)


def test_edges(spark, doc_rows):
    rows = {r["doc_id"]: r for r in L.identify(doc_rows).collect()}
    assert rows[3]["lang_pred"] == "und" and rows[4]["lang_pred"] == "und" and rows[6]["lang_pred"] == "und"
    assert rows[6]["score"] == 0 and rows[1]["lang_pred"] in ("en", "fr")
    kept = L.keep_identified(doc_rows)
    assert kept.columns == doc_rows.columns and kept.count() == doc_rows.count() - 3
    assert L.identify(doc_rows.limit(0)).count() == 0
    unlabelled = doc_rows.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in L.identify(unlabelled).collect()} == {"und"}


def test_without_labels_documents_with_letters_stay(spark, doc_rows):
    held_out = next(i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 5 == 0)
    for frame in (doc_rows.selectExpr("doc_id", "text", "cast(null as string) lang", "source"),
                  doc_rows.selectExpr(f"cast({held_out} as long) doc_id", "text", "lang", "source")):
        kept = L.keep_identified(frame)
        assert kept.columns == frame.columns
        got = sorted((r["text"] for r in kept.collect()))
        assert got == sorted(r["text"] for r in doc_rows.collect() if r["text"] and any(c.isalpha() for c in r["text"]))
