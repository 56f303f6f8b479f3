import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import dispatch, metrics

JOBS = [  # every row of the dispatch table
    ("a1", "p", "ON_ATTRIBUTE", "python", "bag-of-characters", "bag_of_characters", 128, None, None),
    ("a2", "p", "ON_ATTRIBUTE", "python", "bag-of-words", "bag_of_words", 128, 64, None),
    ("a3", "p", "ON_ATTRIBUTE", "python", "tf-idf", "tfidf", 128, None, None),
    ("a4", "p", "ON_ATTRIBUTE", "python", "word2vec", None, None, None, "Unknown model word2vec"),
    ("a5", "p", "ON_ATTRIBUTE", "openai", "text-embedding-3-small", "openai", 128, 64, None),
    ("a6", "p", "ON_ATTRIBUTE", "azure", "x", "openai", 128, 64, None),
    ("a7", "p", "ON_ATTRIBUTE", "huggingface", "bert-base-uncased", "huggingface", 128, 64, None),
    ("a8", "p", "ON_ATTRIBUTE", "cohere", "any", "cohere", 128, 64, None),
    ("a9", "p", "ON_ATTRIBUTE", "nope", "any", None, None, None, "Unknown platform nope"),
    ("t1", "p", "ON_TOKEN", "python", "bag-of-characters", "token_bag_of_characters", 32, None, None),
    ("t2", "p", "ON_TOKEN", "python", "bag-of-words", None, None, None, "x"),
    ("t3", "p", "ON_TOKEN", "python", "tf-idf", None, None, None, "x"),
    ("t4", "p", "ON_TOKEN", "huggingface", "distilbert-base-uncased", "token_transformer", 32, 16, None),
]


def test_dispatch_table_row_by_row(spark):
    jobs = spark.createDataFrame([j[:5] for j in JOBS], "job_id string, project_id string, type string, "
                                                        "platform string, model string")
    counts = spark.createDataFrame([("p", 64)], "project_id string, n_records long")
    got = {r["job_id"]: r for r in dispatch.job_resolve(jobs, counts).collect()}
    for job_id, _, _, _, _, emb, batch, comps, err in JOBS:
        r = got[job_id]
        assert r["embedder"] == emb, job_id
        assert r["batch_size"] == batch, job_id
        assert r["n_components"] == comps, job_id
        assert (r["error"] is None) == (err is None), job_id
        if err and err != "x":
            assert r["error"] == err


def test_pca_threshold_63_vs_64_records(spark):
    jobs = spark.createDataFrame([("a", "p63", "ON_ATTRIBUTE", "python", "bag-of-words"),
                                  ("b", "p64", "ON_ATTRIBUTE", "python", "bag-of-words")],
                                 "job_id string, project_id string, type string, platform string, model string")
    counts = spark.createDataFrame([("p63", 63), ("p64", 64)], "project_id string, n_records long")
    got = {r["job_id"]: r["reduce"] for r in dispatch.job_resolve(jobs, counts).collect()}
    assert got == {"a": False, "b": True}


def test_progress_with_zero_expected(spark):
    e = spark.createDataFrame([("j", 0), ("k", 300)], "job_id string, expected long")
    rows = {(r["job_id"], r["batch"]): r["progress"] for r in metrics.progress_by_batch(e).collect()}
    assert rows[("j", -1)] == 0.1
    assert rows[("k", 2)] == 0.99 and rows[("k", 0)] == round(0.1 + 128 / 300 * 0.9, 6)


def test_warning_report_with_zero_one_two_primary_keys(spark):
    w = spark.createDataFrame([("p0", "r1", "TOKEN_MISMATCHING", 0), ("p0", "r2", "TOKEN_MISMATCHING", 1),
                               ("p1", "r9", "DOCUMENT_IS_SPLITTED", 3), ("p2", "r5", "DOCUMENT_IS_SPLITTED", 0)],
                              "project_id string, record_id string, warning_type string, pos int")
    data = spark.createDataFrame([("p0", "r2", {"id": "2"}), ("p1", "r9", {"id": "9", "name": "x"}),
                                  ("p2", "r5", {"a": "A", "b": "B"})],
                                 "project_id string, record_id string, data map<string,string>")
    attrs = spark.createDataFrame([("p1", "id", True), ("p2", "a", True), ("p2", "b", True), ("p0", "id", False)],
                                  "project_id string, name string, is_primary_key boolean")
    got = {r["project_id"]: r for r in metrics.warning_report(w, data, attrs).collect()}
    assert got["p0"]["record_number"] == 2 and got["p0"]["example_record_id"] == "r2"
    assert got["p0"]["message"].endswith("record  with record id: r2.")
    assert got["p1"]["message"].endswith("record with primary key: 9.")
    assert got["p2"]["message"].endswith("record with primary key: A, B.")


def test_latest_state_equal_timestamps_break_by_event_id(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, "j", t, "ENCODING"), (2, "j", t, "FAILED"), (3, "k", t, "FINISHED")],
                               "event_id long, job_id string, ts timestamp, state string")
    got = {r["job_id"]: r["state"] for r in metrics.job_latest_state(ev).collect()}
    assert got == {"j": "FAILED", "k": "FINISHED"}


def test_vector_count_check_unknown_and_mismatch(spark):
    ch = spark.createDataFrame([("j", "r1"), ("j", "r2"), ("u", "r3")], "job_id string, record_id string")
    vec = spark.createDataFrame([("j", "r1"), ("j", "r2")], "job_id string, record_id string")
    got = {r["job_id"]: r["ok"] for r in metrics.vector_count_check(ch, vec).collect()}
    assert got == {"j": True, "u": False}


def test_catalog_has_13_models(spark):
    c = dispatch.catalog_frame(spark)
    assert c.count() == 13
    assert c.filter(F.col("applicability.token")).count() == 8
