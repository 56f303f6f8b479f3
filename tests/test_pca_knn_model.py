import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import knn, pca
from tessera.operators.model_embed import model_embed


def dense_frame(spark, x, job="j"):
    rows = [(job, str(i), None, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "job_id string, record_id string, sub_key int, vector array<double>")


def test_narrow_pca_invariants(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12))
    df = dense_frame(spark, x)
    fit = pca.narrow_fit(df, 12)["j"]
    v = fit["components"]
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-9)              # orthonormal
    assert np.all(np.diff(fit["explained"]) <= 1e-12)                      # variance descending
    idx = np.argmax(np.abs(v), axis=0)
    assert np.all(v[idx, np.arange(v.shape[1])] > 0)                       # sign rule
    out = pca.narrow_transform(df, {"j": fit}, ["job_id", "record_id", "sub_key"])
    y = np.vstack([np.asarray(r["vector"]) for r in out.orderBy(F.col("record_id").cast("int")).collect()])
    xc = x - x.mean(axis=0)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(xc, axis=1))   # full rank keeps distances


def test_narrow_pca_fewer_rows_than_components(spark):
    df = dense_frame(spark, np.eye(3))
    fit = pca.narrow_fit(df, 64)["j"]
    assert fit["components"].shape[1] <= 2


def test_randomized_pca_captures_variance(spark):
    from tessera.plans.reduce import bow_pca_embed
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab[: 30 + (i % 5) * 50], size=40)) for i in range(120)]
    units = spark.createDataFrame([("j", str(i), None, t) for i, t in enumerate(texts)],
                                  "job_id string, record_id string, sub_key int, text string")
    counts = spark.createDataFrame([("j", 120)], "job_id string, n_records long")
    out = bow_pca_embed(units, counts, k=8).collect()
    y = np.zeros((120, 8))
    for r in out:
        y[int(r["record_id"]), int(r["position"])] = r["value"]
    assert np.allclose(y.mean(axis=0), 0, atol=1e-8)                       # centred coordinates
    # compare captured variance with the exact top-8 of the same counts
    cols = {w: i for i, w in enumerate(sorted(set(" ".join(texts).split())))}
    x = np.zeros((120, len(cols)))
    for i, t in enumerate(texts):
        for w in t.split():
            x[i, cols[w]] += 1
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert (y ** 2).sum() >= 0.9 * (s[:8] ** 2).sum()
    g = y.T @ y
    assert np.allclose(g - np.diag(np.diag(g)), 0, atol=1e-6 * np.trace(g))  # uncorrelated components


def test_knn_matches_brute_force_and_block_path(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(f"{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)],
                               "id string, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["neighbor_id"]) for r in knn.knn_topk(df, df, 4, True).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = []
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], f"{j:03d}"))[:4]
        want += [(f"{i:03d}", r + 1, f"{j:03d}") for r, j in enumerate(order)]
    assert got == sorted(want)
    monkeypatch.setattr(knn, "MAX_QUERY_BLOCK_BYTES", 8 * 5 * 10)          # force several query blocks
    again = sorted((r["query_id"], r["rank"], r["neighbor_id"]) for r in knn.knn_topk(df, df, 4, True).collect())
    assert again == got


def test_model_embed_batches_errors_and_split(spark):
    def make():
        def fn(texts):
            assert len(texts) <= 3
            if any("boom" in t for t in texts):
                raise ConnectionError("down")
            return np.array([[len(t), 1.0] for t in texts])
        return fn
    u = spark.createDataFrame([("j", "a", None, "x" * 25), ("j", "b", None, "boom"), ("j", "c", None, "")],
                              "job_id string, record_id string, sub_key int, text string").coalesce(1)
    got = {r["record_id"]: r for r in model_embed(u, make, batch_size=3, max_chars=10, dim=2).collect()}
    assert got["a"]["n_parts"] == 3
    assert np.allclose(got["a"]["vector"], [(10 * 10 + 10 * 10 + 5 * 5) / 25, 1.0])  # length-weighted mean
    assert got["b"]["error_class"] == "connection" and got["b"]["vector"] is None
    assert got["c"]["vector"] == [0.0, 0.0] and got["c"]["n_parts"] == 0


def test_token_model_embed_reduces_to_16_centred(spark):
    from tessera.plans.reduce import token_model_embed
    texts = ["the quick brown fox jumps over the lazy dog", "a stitch in time saves nine",
             "to be or not to be that is the question", "all that glitters is not gold"] * 5
    rows = [("j", str(i), t_idx, tok) for i, t in enumerate(texts) for t_idx, tok in enumerate(t.split())]
    toks = spark.createDataFrame(rows, "job_id string, record_id string, sub_key int, text string")
    out = token_model_embed(toks).collect()
    assert len(out) == len(rows)                                  # one vector per token
    y = np.vstack([np.asarray(r["vector"]) for r in out])
    assert 0 < y.shape[1] <= 16
    assert np.allclose(y.mean(axis=0), 0, atol=1e-9)


def test_compact_model_vectors_equal_dense_ones_whatever_the_batch(spark):
    from pyspark.sql import functions as F

    from tessera.functions.vectors import dense_of
    from tessera.operators import model_embed as me
    from tessera.operators import pca

    def largest():
        sizes = []

        def fn(texts):
            sizes.append(len(texts))
            if any(t == "bad" for t in texts):
                raise RuntimeError("no")
            return np.array([[len(t) * (i == 3) + i * (len(t) > 40) for i in range(8)] for t in texts], dtype=float)
        return fn

    rows = [("j", str(i), i, "t" * (i % 50)) for i in range(3000)] + [("k", "x", None, None), ("k", "y", 0, "bad")]
    units = spark.createDataFrame(rows, "job_id string, record_id string, sub_key int, text string").coalesce(1)
    dense = me.model_embed(units.where("job_id = 'j'"), largest, 16, dim=8)
    few = me.model_embed(units.where("job_id = 'j'"), largest, 16, dim=8, compact=True)
    want = {r["record_id"]: r["vector"] for r in dense.collect()}
    assert want == {r["record_id"]: r["v"] for r in few.select("record_id", dense_of(of="double").alias("v")).collect()}
    assert few.where("positions is not null and size(vector) <= 1").count() > 2000
    assert few.where("positions is null and size(vector) = 8").count() > 100
    failed = {r["record_id"]: r for r in me.model_embed(units.where("job_id = 'k'"), largest, 1, dim=8, compact=True).collect()}
    assert failed["y"]["error_class"] == "general" and failed["y"]["vector"] is None and failed["x"]["error_class"] is None
    a, b = pca.narrow_fit(dense, 2)["j"], pca.narrow_fit(few, 2)["j"]
    assert a["n"] == b["n"] == 3000 and np.allclose(a["cov"], b["cov"])
    c = pca.narrow_components(few, 2)["j"]
    assert np.allclose(c["mean"], a["mean"]) and np.allclose(c["components"], a["components"])
    same = pca.narrow_components(few.where("record_id = '5'"), 2)["j"]   # one row has no direction
    assert same["components"].shape == (8, 0)
    keys = ["job_id", "record_id", "sub_key"]
    out = [{r["record_id"]: r["vector"] for r in pca.narrow_transform(v, {"j": a}, keys).collect()} for v in (dense, few)]
    assert out[0].keys() == out[1].keys() and all(np.allclose(out[0][i], out[1][i]) for i in out[0])


def test_pieces_bound_what_a_worker_embeds_at_once():
    import pyarrow as pa

    from tessera.operators import model_embed as me
    n = 5 * me.PIECE_ROWS
    batch = pa.RecordBatch.from_arrays([pa.array(["j"] * n), pa.array(["r"] * n), pa.array([0] * n, pa.int32()), pa.array(["t"] * n)],
                                       names=["job_id", "record_id", "sub_key", "text"])
    run = me._embed_partition(lambda: lambda texts: np.ones((len(texts), 4)), 32, 100, 4, False)
    assert [b.num_rows for b in run(iter([batch]))] == [me.PIECE_ROWS] * 5


def test_token_contexts_shuffle_records_not_tokens(spark, sf_small):
    from tessera.plans import queries as q
    from tessera.plans import reduce as rplans
    from tessera.session import spread
    contexts = rplans.token_contexts(q._token_units(spark, sf_small, by_record=True))
    plan = contexts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")   # the shuffle lies below the tokens
    assert spread(contexts) is contexts
    want = rplans.token_contexts(q._token_units(spark, sf_small))
    assert contexts.exceptAll(want).count() == 0 and contexts.count() == want.count()


def test_knn_ranks_only_pairs_that_can_be_among_the_best(monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[99] * 2                                                  # many equal scores
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([str(i) for i in range(600)], dtype=object)
    batches = [pd.DataFrame({"id": ids[a:a + 150], "vector": list(x[a:a + 150])}) for a in range(0, 600, 150)]
    seen = []
    offer = knn.Best.merge_pairs
    monkeypatch.setattr(knn.Best, "merge_pairs", lambda self, r, s, i: (seen.append(len(r)), offer(self, r, s, i)))
    monkeypatch.setattr(knn.Best, "merge", None)                            # ranks whole pieces
    got, = knn._local_topk(ids, unit, 5, True, 6, 1 << 14, None)(iter(batches))
    s = np.round(unit @ unit.T, 6)
    want = {(str(i), str(j)) for i in range(600)
            for j in sorted((j for j in range(600) if j != i), key=lambda j: (-s[i, j], str(j)))[:5]}
    assert set(zip(got["query_id"], got["neighbor_id"])) == want
    assert sum(seen) < 0.1 * s.size
