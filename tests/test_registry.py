"""The embedder registry, re-embedding by it, commits with cancellation, and the ledger of stream batches."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pca
from tessera.plans import encode, reduce
from tessera.plans import jobs as plans
from tessera.schema import BOC, BOW, MODEL_PCA, REDUCED_BOW, TFIDF
from tessera.sinks import registry
from tessera.sinks.vector_store import VectorStore
from tessera.streaming import jobs as streams

UNITS = "project_id string, record_id string, sub_key int, text string"
JOBS = "job_id string, project_id string, attribute_id string, type string, platform string, model string"


def texts(n, seed=3, words=12, length=30):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice([f"w{i}" for i in range(words)], length)) for _ in range(n)]


def corpus(spark, n=64):
    body = texts(n)
    units = spark.createDataFrame([("p", f"r{i}", None, t) for i, t in enumerate(body)], UNITS)
    return body, units


def tokens_of(spark, rows):
    return spark.createDataFrame([("p", r, k, w) for r, t in rows for k, w in enumerate((t or "").split())], UNITS)


def run(spark, jobs, units, tokens, n=64, provider=plans.built_in, **kw):
    store = VectorStore(spark)
    counts = spark.createDataFrame([("p", n)], "project_id string, n_records long")
    frame = spark.createDataFrame([(j, "p", "text", *rest) for j, *rest in jobs], JOBS)
    states = encode.encode_jobs(store, frame, counts, units, tokens, provider, export=False, build_collection=False, **kw)
    return store, {r["job_id"]: r["state"] for r in states.collect()}


def vectors(store):
    return {(r["job_id"], r["record_id"], r["sub_key"]): r["vector"] for r in store.vectors().collect()}


def changes(spark, by_job):
    return spark.createDataFrame([(json.dumps(by_job),)], "value string")


def entry(record, **more):
    return {"record_id": record, "attribute_name": "text", **more}


def test_factor_table_equals_the_driver_fit(spark):
    x = np.random.default_rng(1).normal(size=(50, 6))
    rows = [("a", f"r{i}", None, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [("same", f"r{i}", None, [1.0, 2.0]) for i in range(4)] + [("one", "r", None, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "job_id string, record_id string, sub_key int, vector array<double>")
    path = f"{VectorStore(spark).root}/factors"
    pca.narrow_factors(df, 3).write.parquet(path)
    factors = spark.read.parquet(path)
    means = factors.filter(F.col("position") == pca.MEAN).select("job_id", F.col("loadings").alias("mean"))
    got = {(r["job_id"], r["record_id"]): r["vector"] for r in pca.project(
        pca.dense_rows(df), factors.filter("position >= 0"), means).collect()}
    want = pca.narrow_transform(df, pca.narrow_fit(df, 3), ["job_id", "record_id", "sub_key"])
    for r in want.filter("job_id = 'a'").collect():
        assert np.allclose(got["a", r["record_id"]], r["vector"], atol=1e-9)
    assert len(got) == len(rows)
    assert got["same", "r0"] == got["one", "r"] == [0.0]      # no direction


ALL_KINDS = [("chars", "ON_ATTRIBUTE", "python", BOC), ("tfidf", "ON_ATTRIBUTE", "python", TFIDF),
             ("words", "ON_ATTRIBUTE", "python", BOW), ("model", "ON_ATTRIBUTE", "openai", "m1"),
             ("tok", "ON_TOKEN", "python", BOC), ("tokmodel", "ON_TOKEN", "huggingface", "m2")]


def test_every_kind_is_embedded_again_by_its_own_embedder(spark):
    body, units = corpus(spark)
    rows = [(f"r{i}", t) for i, t in enumerate(body)]
    store, states = run(spark, ALL_KINDS, units, tokens_of(spark, rows))
    assert set(states.values()) == {"FINISHED"}
    saved = {r["job_id"]: r["saved"] for r in registry.embedders(spark, store.root).collect()}
    assert saved == {"chars": BOC, "tfidf": TFIDF, "words": REDUCED_BOW, "model": MODEL_PCA, "tok": BOC, "tokmodel": MODEL_PCA}
    before = vectors(store)
    # r1 gets r2's text; r3 loses all its text; the job "gone" has no embedder
    new = [(r, body[2] if r == "r1" else None if r == "r3" else t) for r, t in rows]
    records = spark.createDataFrame([("p", *r) for r in new], "project_id string, record_id string, text string")
    asked = {j: [entry("r1"), entry("r3"), entry("r1")] for j, *_ in ALL_KINDS} | {"gone": [entry("r1")]}
    check = plans.re_embed(store, changes(spark, asked), records, tokens=tokens_of(spark, new), export=False)
    assert {r["job_id"]: (r["n_changes"], r["ok"]) for r in check.collect()} == {j: (2, True) for j, *_ in ALL_KINDS}
    after = vectors(store)
    for (job, record, sub), old in before.items():
        if record == "r3" and job.startswith("tok"):
            assert (job, record, sub) not in after                       # tokens that are gone
        elif record == "r1":
            assert np.allclose(after[job, record, sub], before[job, "r2", sub], atol=1e-5)
        elif record == "r3":
            assert (job, record, sub) in after
        else:
            assert after[job, record, sub] == old
    assert {k[:2] for k in after} == {k[:2] for k in before} - {("tok", "r3"), ("tokmodel", "r3")}


def scores(store, items, job, width=None):
    """(record, sub_key) -> vector; with ``width`` the positions that were left out are 0."""
    out = {}
    for r in plans.score_with_job(store, items, job).collect():
        v = out.setdefault((r["record_id"], r["sub_key"]), {})
        v[r["position"]] = r["value"]
    return {k: [v.get(i, 0.0) for i in range(width)] for k, v in out.items()}


def test_scoring_uses_the_registered_embedder(spark):
    body, units = corpus(spark)
    kinds = [k for k in ALL_KINDS if k[0] in ("tfidf", "words", "model", "tok")]
    store, _ = run(spark, kinds, units, tokens_of(spark, [("r0", body[0])]))
    stored = vectors(store)
    items = spark.createDataFrame([(1, body[0]), (2, None), (3, "")], "item_id long, text string")
    for job in ("tfidf", "words", "model"):
        want = stored[job, "r0", None]
        got = scores(store, items, job, len(want))
        assert np.allclose(got["1", None], want, atol=1e-5)
        if job == "tfidf":
            assert got.keys() == {("1", None)}                 # no word, no row
        else:
            assert got.keys() == {(i, None) for i in "123"} and np.allclose(got["2", None], got["3", None])
    width = len(stored["tok", "r0", 0])
    assert scores(store, items, "tok", width) == {("1", k): stored["tok", "r0", k] for k in range(30)}
    assert plans.score_with_job(store, items, "unknown").count() == 0
    assert plans.score_with_job(store, items.limit(0), "tfidf").count() == 0
    store.delete_job("tfidf")
    assert plans.score_with_job(store, items, "tfidf").count() == 0
    assert ("model-pca", "model") in store.model_jobs() and "tfidf" not in {j for _, j in store.model_jobs()}


def test_a_failing_model_or_missing_record_leaves_the_store(spark):
    body, units = corpus(spark, 8)
    fails = [False]

    def provider(platform, model):
        def make():
            def fn(batch):
                raise RuntimeError("down")
            return fn
        return make if fails[0] else None
    store, _ = run(spark, [("model", "ON_ATTRIBUTE", "openai", "m1")], units, tokens_of(spark, []), 8, provider)
    before = vectors(store)
    records = units.select("project_id", "record_id", "text")
    with pytest.raises(RuntimeError, match="does not match"):
        plans.re_embed(store, changes(spark, {"model": [entry("nobody")]}), records, export=False)
    with pytest.raises(RuntimeError, match="does not match"):     # no list contents were handed in
        plans.re_embed(store, changes(spark, {"model": [entry("r1", sub_key="0")]}), records, export=False)
    fails[0] = True
    with pytest.raises(RuntimeError, match="model failed for job model"):
        plans.re_embed(store, changes(spark, {"model": [entry("r1")]}), records, provider=provider, export=False)
    assert vectors(store) == before
    assert plans.score_with_job(store, spark.createDataFrame([(1, "x")], "item_id long, text string"), "model", provider).count() == 0


def test_list_entries_as_arrays_and_as_rows(spark):
    lists = {"c1": ["a b", "b c", None], "c2": ["c c c"]}
    rows = [("l", r, k, t) for r, ts in lists.items() for k, t in enumerate(ts)]
    units = spark.createDataFrame(rows, UNITS.replace("project_id", "job_id"))
    records = spark.createDataFrame([], "project_id string, record_id string, text string")
    now = {"c1": ["a b", "a a a", None], "c2": ["a"]}
    as_arrays = spark.createDataFrame([("l", r, ts) for r, ts in now.items()], "project_id string, record_id string, texts array<string>")
    as_rows = spark.createDataFrame([("l", r, k, t) for r, ts in now.items() for k, t in enumerate(ts)], UNITS)
    for contents in (as_arrays, as_rows):
        store = VectorStore(spark)
        plans.encode_job(store, units, BOW, build_collection=False, export=False)
        asked = changes(spark, {"l": [entry("c1", sub_key="1"), entry("c2", sub_key="0"), entry("c1", sub_key="2")]})
        plans.re_embed(store, asked, records, list_records=contents, export=False)
        assert {k[1:]: v for k, v in vectors(store).items()} == {
            ("c1", 0): [1, 1, 0], ("c1", 1): [3, 0, 0], ("c1", 2): [0, 0, 0], ("c2", 0): [1, 0, 0]}
        with pytest.raises(RuntimeError, match="does not match"):
            plans.re_embed(store, changes(spark, {"l": [entry("c2", sub_key="1")]}), records, list_records=contents, export=False)


def test_commits_write_the_same_and_cancelled_jobs_keep_earlier_batches(spark):
    body, units = corpus(spark, 70)
    rows = [(f"r{i}", t) for i, t in enumerate(body)]
    kinds = ALL_KINDS[:4] + [("tok", "ON_TOKEN", "python", BOC), ("tok2", "ON_TOKEN", "python", BOC)]
    store, states = run(spark, kinds, units, tokens_of(spark, rows), 70)
    whole = vectors(store)

    def cancel(number):
        if number == 1 and "tok2" in open_stores[0]:
            jobs = spark.createDataFrame([("tok2",)], "job_id string")
            plans.append_events(open_stores[1], plans.state_rows(jobs, "FAILED"))

    open_stores = [{"tok2"}, VectorStore(spark)]
    counts = spark.createDataFrame([("p", 70)], "project_id string, n_records long")
    frame = spark.createDataFrame([(j, "p", "text", *rest) for j, *rest in kinds], JOBS)
    got_states = {r["job_id"]: r["state"] for r in encode.encode_jobs(
        open_stores[1], frame, counts, units, tokens_of(spark, rows), export=False, build_collection=False,
        commits=3, before_commit=cancel).collect()}
    assert got_states == {**states, "tok2": "FAILED"}
    got = vectors(open_stores[1])
    order = sorted((r, k) for j, r, k in whole if j == "tok2")
    batches = -(-len(order) // 32)
    kept = {(r, k) for i, (r, k) in enumerate(order) if i // 32 * 3 // batches < 1}
    assert {(r, k) for j, r, k in got if j == "tok2"} == kept and 0 < len(kept) < len(order)
    for key, v in whole.items():
        if key[0] != "tok2" or key[1:] in kept:
            assert np.allclose(got[key], v, atol=1e-5)
    assert len(got) == len(whole) - len(order) + len(kept)
    assert "tok2" not in {r["job_id"] for r in registry.embedders(spark, open_stores[1].root).collect()}
    done = encode.notifications(open_stores[1]).filter("type = 'EMBEDDING_CREATION_DONE'")
    assert {r["job_id"] for r in done.collect()} == {j for j, *_ in kinds} - {"tok2"}


def test_commit_plan_is_even_and_in_order(spark):
    rows = [("a", f"r{i:03d}", None, "x") for i in range(10)] + [("b", "r", k, "x") for k in range(3)] + [("b", "q", None, "x")]
    got = encode.commit_plan(spark.createDataFrame(rows, UNITS.replace("project_id", "job_id")), 2, 3).collect()
    of = {}
    for r in sorted(got, key=lambda r: (r["job_id"], r["record_id"], -1 if r["sub_key"] is None else r["sub_key"])):
        of.setdefault(r["job_id"], []).append(r["commit"])
    assert of == {"a": [0, 0, 0, 0, 1, 1, 1, 1, 2, 2], "b": [0, 0, 1, 1]}


def test_a_batch_is_applied_once(spark):
    _, units = corpus(spark, 6)
    as_job = units.withColumnRenamed("project_id", "job_id")
    store = VectorStore(spark)
    plans.encode_job(store, as_job, BOW, build_collection=False)
    records = units.select("project_id", "record_id", "text")
    edited = records.withColumn("text", F.lit("w1 w1"))
    change_dir, checkpoint = f"{store.root}/incoming", f"{store.root}/ckpt"
    changes(spark, {"p": [entry("r1")]}).write.mode("append").text(change_dir)
    streams.re_embed_stream(spark, store, change_dir, edited, checkpoint=checkpoint)
    first, checks = vectors(store), streams.re_embed_checks(store).collect()
    assert sum(first["p", "r1", None]) == 2 and sum(first["p", "r2", None]) == 30
    assert [(r["job_id"], r["n_changes"], r["batch"]) for r in checks] == [("p", 1, 0)]
    states = store._states()
    # the same batch again with other contents, as after a crash before Spark noted it
    again = streams.re_embed_batch(spark, store, checkpoint, records)
    again(changes(spark, {"p": [entry("r1"), entry("r2")]}), 0)
    assert vectors(store) == first and streams.re_embed_checks(store).collect() == checks and store._states() == states
    changes(spark, {"p": [entry("r2")]}).write.mode("append").text(change_dir)
    streams.re_embed_stream(spark, store, change_dir, edited, checkpoint=checkpoint)
    assert sum(vectors(store)["p", "r2", None]) == 2
    # another stream has batches of its own
    other = streams.re_embed_batch(spark, store, f"{store.root}/other", records)
    other(changes(spark, {"p": [entry("r1")]}), 0)
    assert sum(vectors(store)["p", "r1", None]) == 30 and streams.re_embed_checks(store).count() == 3


def test_a_broken_off_batch_is_run_again(spark, monkeypatch):
    _, units = corpus(spark, 4)
    store = VectorStore(spark)
    plans.encode_job(store, units.withColumnRenamed("project_id", "job_id"), BOW, build_collection=False, export=False)
    edited = units.select("project_id", "record_id", F.lit("w1").alias("text"))
    apply = streams.re_embed_batch(spark, store, f"{store.root}/ckpt", edited, export=False)
    batch = changes(spark, {"p": [entry("r1")]})
    build = VectorStore.build_collection
    monkeypatch.setattr(VectorStore, "build_collection", lambda *a, **k: 1 / 0)   # after the upsert
    with pytest.raises(ZeroDivisionError):
        apply(batch, 0)
    assert streams.re_embed_checks(store).count() == 0
    monkeypatch.setattr(VectorStore, "build_collection", build)
    apply(batch, 0)
    got = vectors(store)
    assert sum(got["p", "r1", None]) == 1 and len(got) == 4 and streams.re_embed_checks(store).count() == 1
