import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn, metrics
from tessera.operators.model_embed import model_embed
from tessera.plans import encode, reduce
from tessera.plans import jobs as plans
from tessera.schema import BOW, ERR_OPENAI_KEY, MSG_OPENAI_KEY, REDUCED_BOW
from tessera.sinks.vector_store import VectorStore
from tessera.streaming import jobs as streams

UNITS = "job_id string, record_id string, sub_key int, text string"
JOBS = "job_id string, project_id string, attribute_id string, type string, platform string, model string"


def texts(n, seed=3, words=10, length=30):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice([f"w{i}" for i in range(words)], length)) for _ in range(n)]


def test_reduced_model_transforms_like_its_fit_and_reloads(spark):
    u = spark.createDataFrame([("j", f"r{i}", None, t) for i, t in enumerate(texts(70))]
                              + [("same", f"r{i}", None, "x y") for i in range(5)], UNITS)
    model, coords = reduce.fit_reduced(u, 12)
    store = VectorStore(spark)
    plans.save_model(store, REDUCED_BOW, model)
    again = plans.load_model(store, REDUCED_BOW).dense(u)
    want = {(r["job_id"], r["record_id"]): r["vector"] for r in coords.collect()}
    got = {(r["job_id"], r["record_id"]): r["vector"] for r in again.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    new = plans.load_model(store, REDUCED_BOW).dense(spark.createDataFrame([("j", "n", None, "zzz unseen"), ("j", "e", None, None)], UNITS))
    vectors = {r["record_id"]: r["vector"] for r in new.collect()}
    assert np.allclose(vectors["n"], vectors["e"])       # no known word: both are the zero row, centred
    store.delete_job("j")
    assert [j for n, j in store.model_jobs() if n == REDUCED_BOW] == ["same"]


def _encode(spark, provider):
    body = texts(64)
    units = spark.createDataFrame([("p", f"r{i}", None, t) for i, t in enumerate(body)], UNITS.replace("job_id", "project_id"))
    tokens = spark.createDataFrame([("p", f"r{i}", k, w) for i, t in enumerate(body[:8]) for k, w in enumerate(t.split())],
                                   UNITS.replace("job_id", "project_id"))
    jobs = spark.createDataFrame([
        ("bow", "p", "text", "ON_ATTRIBUTE", "python", BOW), ("oai", "p", "text", "ON_ATTRIBUTE", "openai", "m1"),
        ("tok", "p", "text", "ON_TOKEN", "huggingface", "m2"), ("bad", "p", "text", "ON_TOKEN", "python", BOW)], JOBS)
    store = VectorStore(spark)
    counts = spark.createDataFrame([("p", 64)], "project_id string, n_records long")
    states = {r["job_id"]: r["state"] for r in encode.encode_jobs(
        store, jobs, counts, units, tokens, provider, export=False, build_collection=False).collect()}
    return store, states


def test_encode_jobs_reduces_and_fails_as_a_whole(spark):
    def provider(platform, model):
        if platform != "openai":
            return None

        def make():
            def fn(batch):
                raise RuntimeError(ERR_OPENAI_KEY)
            return fn
        return make
    store, states = _encode(spark, provider)
    assert states == {"bow": "FINISHED", "oai": "FAILED", "tok": "FINISHED", "bad": "FAILED"}
    assert {r["job_id"]: r["state"] for r in plans.job_states(store).collect()} == states
    rows = {r["job_id"]: (r["n"], r["w"]) for r in store.vectors().groupBy("job_id").agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("w")).collect()}
    assert rows.keys() == {"bow", "tok"}
    assert rows["bow"][0] == 64 and rows["bow"][1] <= 10        # reduced to its rank
    assert rows["tok"] == (240, 16) or rows["tok"][1] <= 16
    notes = {(r["job_id"], r["message"]) for r in encode.notifications(store).filter("level = 'ERROR'").collect()}
    assert ("oai", MSG_OPENAI_KEY) in notes and {j for j, _ in notes} == {"oai", "bad"}


def test_get_warnings_of_split_and_mismatching_units(spark):
    u = spark.createDataFrame([("j", "long", None, "x" * 500), ("j", "short", None, "a")], UNITS)
    out = model_embed(u)
    tokens = spark.createDataFrame([("j", "long"), ("j", "short"), ("j", "short")], "job_id string, record_id string")
    got = {tuple(r) for r in metrics.get_warnings(out, tokens).collect()}
    assert got == {("j", "long", "DOCUMENT_IS_SPLITTED"), ("j", "short", "TOKEN_MISMATCHING")}


def test_removed_jobs_cut_their_batches(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(4)]
    ev = spark.createDataFrame([(1, "a", t[0], "ENCODING"), (2, "a", t[2], "ENCODING"), (3, "b", t[0], "ENCODING")],
                               "event_id long, job_id string, ts timestamp, state string")
    removed = spark.createDataFrame([("a", t[1])], "job_id string, ts timestamp")
    got = {r["job_id"]: (r["kept_batches"], r["cut_batches"]) for r in metrics.cancel_cut(ev, removed).collect()}
    assert got == {"a": (1, 1), "b": (1, 0)}


def test_azure_requests_are_capped():
    assert encode.batch_size(128, "azure") == 16 and encode.batch_size(128, "openai") == 128


def test_job_states_go_on_after_a_restart(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "event_id long, job_id string, ts timestamp, state string"
    inp, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inp)
        stream = spark.readStream.schema(schema).parquet(inp)
        streams.job_state_stream(spark, stream, out, checkpoint=ckpt)
        return {r["job_id"]: r["state"] for r in streams.current_job_states(spark, out).collect()}
    assert arrive([(1, "a", t, "ENCODING"), (2, "b", t, "FAILED")]) == {"a": "ENCODING", "b": "FAILED"}
    later = t + dt.timedelta(hours=1)
    assert arrive([(3, "a", later, "FINISHED"), (4, "c", later, "WAITING"), (5, "b", t - dt.timedelta(hours=1), "WAITING")]) == {
        "a": "FINISHED", "b": "FAILED", "c": "WAITING"}


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_knn_is_exact_whatever_the_score_bound(spark, monkeypatch, cells):
    x = np.random.default_rng(5).integers(-2, 3, size=(40, 3)).astype(float)     # many ties
    df = spark.createDataFrame([(str(i), [float(v) for v in row]) for i, row in enumerate(x)], "id string, vector array<double>")
    want = [tuple(r) for r in knn.knn_topk(df, df, 5, True).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(knn, "MAX_SCORE_CELLS", cells)
    assert [tuple(r) for r in knn.knn_topk(df, df, 5, True).orderBy("query_id", "rank").collect()] == want
    n = np.linalg.norm(x, axis=1)
    s = np.round(np.divide(x @ x.T, np.outer(n, n), out=np.zeros((40, 40)), where=np.outer(n, n) > 0), 6)
    brute = [(str(i), str(j)) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (-s[i, j], str(j)))[:5]]
    assert sorted((r[0], r[1]) for r in want) == sorted(brute)


def test_probing_recall_and_full_probe_is_exact(spark, sf_small):
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"),
                                                                     F.col("embedding").alias("vector"))
    def pairs(probe):
        return {(r["query_id"], r["neighbor_id"]) for r in knn.knn_topk(emb, emb, 10, True, probe=probe).collect()}
    exact = pairs(None)
    assert pairs(knn.Probe(bits=8, flips=8)) == exact
    assert len(pairs(knn.Probe(bits=8, flips=4)) & exact) >= 0.8 * len(exact)


def test_units_are_projected_where_their_words_are_counted(spark):
    import hashlib
    import zlib

    import numpy as np

    from tessera.plans import reduce
    texts = [("a", "1", "Red red fox"), ("a", "2", ""), ("a", "3", None), ("b", "1", "red fox fox"), (None, "9", "fox"),
             ("b", "2", "one two"), ("b", "2", "two three")]               # b 2 comes twice: each row has the sum of both
    units = spark.createDataFrame([(j, r, None, t) for j, r, t in texts],
                                  "job_id string, record_id string, sub_key int, text string")
    out = reduce.seeded_projection(units, width=150)
    got = sorted((str(r["job_id"]), r["record_id"], list(r["y"])) for r in out.collect())

    def signs(job, word):
        h = hashlib.md5(f"{zlib.adler32(job.encode())}:{word}".encode())
        both = h.digest() + hashlib.md5(h.hexdigest().encode()).digest()
        return 1.0 - 2.0 * np.unpackbits(np.frombuffer(both, dtype=np.uint8))[:150].astype(float)
    want = []
    for j, r, _ in texts:
        mine = " ".join(t or "" for x, y, t in texts if (x, y) == (j, r)).lower().split()
        want.append((str(j), r, list(sum((signs(j, w) for w in mine if j), np.zeros(150)))))
    assert got == sorted(want)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()   # no vocabulary is looked up
