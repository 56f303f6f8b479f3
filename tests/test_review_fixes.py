import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.indexing import ordinal_within
from tessera.functions.text import split_parts
from tessera.operators import pca
from tessera.plans import jobs as plans
from tessera.plans import reduce
from tessera.schema import BOC, BOW
from tessera.sinks.vector_store import VectorStore

UNITS = "job_id string, record_id string, sub_key int, text string"
STORED = "project_id string, job_id string, record_id string, sub_key int, vector array<float>"


def units(spark, jobs):
    return spark.createDataFrame([(j, f"r{i}", None, t) for j, texts in jobs.items() for i, t in enumerate(texts)], UNITS)


def test_pca_of_mixed_empty_and_identical_jobs(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(40)]
    jobs = {"wide": [" ".join(rng.choice(words, 12)) for _ in range(62)],
            "thin": ["a b" if i % 2 else "a c c" for i in range(10)],
            "same": ["x y z"] * 20, "empty": [""] * 9, "gaps": ["" if i % 3 else f"g{i} h" for i in range(12)]}
    u = units(spark, jobs)
    counts = u.groupBy("job_id").agg(F.count("*").alias("n_records"))
    got = reduce.bow_pca_embed(u, counts, 8).groupBy("job_id").agg(
        F.countDistinct("record_id").alias("n"), F.max("position").alias("last"), F.sum(F.abs("value")).alias("size")).collect()
    by = {r["job_id"]: r for r in got}
    assert {j: by[j]["n"] for j in jobs} == {j: len(t) for j, t in jobs.items()}
    assert by["wide"]["last"] == 7 and by["thin"]["last"] == 0
    assert by["same"]["size"] < 1e-6 and by["empty"]["size"] == 0


def test_pca_keeps_distances_at_full_rank_and_is_centred(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(10)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(70)]
    u = units(spark, {"j": texts})
    counts = u.groupBy("job_id").agg(F.count("*").alias("n_records"))
    rows = reduce.bow_pca_embed(u, counts, 12).collect()
    x = np.array([[t.split().count(w) for w in words] for t in texts], dtype=float)
    y = np.zeros((70, 12))
    for r in rows:
        y[int(r["record_id"][1:]), r["position"]] = r["value"]
    def dist(m):
        return ((m[:, None] - m[None]) ** 2).sum(axis=2)
    assert np.allclose(dist(x), dist(y), atol=1e-6)
    assert np.allclose(y.mean(axis=0), 0, atol=1e-8)


def test_more_than_128_components():
    signs = pca.sign_bits(np.array(["0" * 32, "f" * 32]), 300)
    assert signs.shape == (2, 300) and set(np.unique(signs)) == {-1.0, 1.0}
    assert (pca.sign_bits(np.array(["0" * 32]), 80) == signs[:1, :80]).all()


def test_failed_tokens_fail_the_job(spark):
    tokens = spark.createDataFrame([("j", "r", i, f"t{i}") for i in range(40)], UNITS)

    def make():
        def fn(texts):
            raise RuntimeError("down")
        return fn
    with pytest.raises(RuntimeError, match="model failed for job j"):
        reduce.token_model_embed(tokens, make_fn=make, k=2)


@pytest.mark.parametrize("job", ["a:b", "x y", "50%", "a/b=c"])
def test_job_ids_that_need_escaping(spark, job):
    s = VectorStore(spark)
    s.append(spark.createDataFrame([("p", job, "r1", None, [1.0]), ("p", "other", "r1", None, [2.0])], STORED))
    s.export()
    s.build_collection()
    s.export(force=False)
    assert s.read_export().count() == 2
    s.delete_job(job)
    assert [r["job_id"] for r in s.read_export().collect()] == ["other"]
    assert [r["job_id"] for r in s.collection().collect()] == ["other"]
    s.delete_records(spark.createDataFrame([(job, "r1")], "job_id string, record_id string"))
    assert [r["job_id"] for r in s.vectors().collect()] == ["other"]


def test_models_belong_to_jobs(spark):
    s = VectorStore(spark)
    plans.encode_job(s, units(spark, {"1": ["ab"], "x:y": ["cd"]}), BOC, build_collection=False)
    plans.encode_job(s, units(spark, {"2": ["ef"]}), BOC, build_collection=False)
    terms = {(r["job_id"], r["term"]) for r in plans.load_model(s, BOC).vocab().collect()}
    assert terms == {("1", "a"), ("1", "b"), ("x:y", "c"), ("x:y", "d"), ("2", "e"), ("2", "f")}
    s.delete_job("x:y")
    assert sorted(j for _, j in s.model_jobs()) == ["1", "2"]


def test_state_can_go_back(spark):
    s = VectorStore(spark)
    plans.encode_job(s, units(spark, {"j": ["a b"]}), BOW, build_collection=False)
    plans.append_events(s, plans.state_rows(spark.createDataFrame([("j",)], "job_id string"), "ENCODING"))
    assert plans.job_states(s).first()["state"] == "ENCODING"


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("g", 1)], "g string, o int")
    assert sorted((r["g"] or "", r["o"], r["ordinal"]) for r in ordinal_within(df, ["g"], ["o"]).collect()) == [
        ("", 1, 0), ("", 2, 1), ("g", 1, 0)]


def test_parts_of_texts_with_line_breaks(spark):
    df = spark.createDataFrame([("k", "ab\ncd" * 100 + "é"), ("n", None), ("e", "")], "record_id string, text string")
    parts = split_parts(df, ["record_id"], 7).orderBy("part_idx").collect()
    assert "".join(p["part"] for p in parts) == "ab\ncd" * 100 + "é"
    assert [p["part_idx"] for p in parts] == list(range(72)) and {p["n_parts"] for p in parts} == {72}
