from pyspark.sql import functions as F

from tessera.sinks.vector_store import VectorStore

ROWS = [("p", "j1", "r1", None, [1.0, 0.0]), ("p", "j1", "r2", None, [0.0, 2.0]),
        ("p", "j2", "r1", 0, [1.0, 1.0]), ("p", "j2", "r1", 1, [3.0, 4.0]), ("p", "j2", "r2", 0, [0.0, 0.0])]
SCHEMA = "project_id string, job_id string, record_id string, sub_key int, vector array<float>"


def keys(store):
    return sorted((r["job_id"], r["record_id"], r["sub_key"]) for r in store.vectors().collect())


def make(spark):
    s = VectorStore(spark)
    s.append(spark.createDataFrame(ROWS, SCHEMA))
    return s


def test_replace_touches_only_given_jobs(spark):
    s = make(spark)
    s.replace_jobs(spark.createDataFrame([("p", "j1", "r9", None, [5.0, 5.0])], SCHEMA))
    assert keys(s) == [("j1", "r9", None), ("j2", "r1", 0), ("j2", "r1", 1), ("j2", "r2", 0)]


def test_delete_records_and_subkeys_with_zero_and_null(spark):
    s = make(spark)
    s.delete_subkeys(spark.createDataFrame([("j2", "r1", 0), ("j1", "r1", None)],
                                           "job_id string, record_id string, sub_key int"))
    assert keys(s) == [("j1", "r2", None), ("j2", "r1", 1), ("j2", "r2", 0)]
    s.delete_records(spark.createDataFrame([("j2", "r1")], "job_id string, record_id string"))
    assert keys(s) == [("j1", "r2", None), ("j2", "r2", 0)]


def test_delete_last_rows_of_a_job_drops_partition(spark):
    s = make(spark)
    s.delete_records(spark.createDataFrame([("j1", "r1"), ("j1", "r2")], "job_id string, record_id string"))
    assert {k[0] for k in keys(s)} == {"j2"}


def test_upsert_replaces_and_collapses_duplicates(spark):
    s = make(spark)
    new = spark.createDataFrame([("p", "j1", "r1", None, [7.0, 7.0]), ("p", "j1", "r1", None, [7.0, 7.0]),
                                 ("p", "j2", "r1", 1, [9.0, 9.0])], SCHEMA)
    s.upsert(new)
    got = {(r["job_id"], r["record_id"], r["sub_key"]): list(r["vector"]) for r in s.vectors().collect()}
    assert len(got) == 5 and len(s.vectors().collect()) == 5
    assert got[("j1", "r1", None)] == [7.0, 7.0] and got[("j2", "r1", 1)] == [9.0, 9.0]
    assert got[("j2", "r1", 0)] == [1.0, 1.0]


def test_export_round_trip_and_policy(spark):
    s = make(spark)
    s.export()
    e = s.read_export()
    assert sorted((r["job_id"], r["record_id"], r["sub_key"], tuple(r["vector"])) for r in e.collect()) == \
        sorted((j, r, k, tuple(v)) for (_, j, r, k, v) in ROWS)
    s.delete_records(spark.createDataFrame([("j1", "r1")], "job_id string, record_id string"))
    s.export(force=False)
    assert s.read_export().filter(F.col("job_id") == "j1").count() == 2      # kept
    s.export(force=True)
    assert s.read_export().filter(F.col("job_id") == "j1").count() == 1      # replaced


def test_collection_is_normalised_and_drop_job(spark):
    s = make(spark)
    s.build_collection(lsh_buckets=3)
    got = {(r["job_id"], r["record_id"], r["sub_key"]): r for r in s.collection().collect()}
    assert [round(x, 6) for x in got[("j2", "r1", 1)]["unit"]] == [0.6, 0.8]
    assert list(got[("j2", "r2", 0)]["unit"]) == [0.0, 0.0]
    assert all(0 <= r["bucket"] < 8 for r in got.values())
    s.delete_job("j2")
    assert {r["job_id"] for r in s.collection().collect()} == {"j1"}
    assert s.vectors().filter(F.col("job_id") == "j2").count() == 3       # vectors are kept


def test_a_reader_sees_the_state_before_or_after_a_rewrite(spark, monkeypatch):
    s = make(spark)
    before, old_keys = s.vectors(), keys(s)
    seen = []
    commit = VectorStore._commit

    def watched(self, live):
        seen.append(keys(VectorStore(spark, s.root)))          # all files are written, the state is not
        commit(self, live)
    monkeypatch.setattr(VectorStore, "_commit", watched)
    s.upsert(spark.createDataFrame([("p", "j1", "r1", None, [7.0, 7.0]), ("p", "j1", "r3", None, [8.0, 8.0])], SCHEMA))
    assert seen == [old_keys]
    got = {(r["job_id"], r["record_id"]): list(r["vector"]) for r in before.collect() if r["job_id"] == "j1"}
    assert got == {("j1", "r1"): [1.0, 0.0], ("j1", "r2"): [0.0, 2.0]}   # a scan begun before reads on
    assert sorted(old_keys + [("j1", "r3", None)], key=str) == sorted(keys(s), key=str)
    s.vacuum()
    assert sorted(old_keys + [("j1", "r3", None)], key=str) == sorted(keys(s), key=str)


def test_a_failed_write_leaves_the_store(spark, monkeypatch):
    s = make(spark)
    old = keys(s)

    def lost(*_):
        raise RuntimeError("driver lost")
    monkeypatch.setattr("tessera.sinks.vector_store.create_marker", lost)
    try:
        s.delete_records(spark.createDataFrame([("j2", "r1")], "job_id string, record_id string"))
        raise AssertionError("must fail")
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert keys(VectorStore(spark, s.root)) == old
    s.delete_records(spark.createDataFrame([("j2", "r1")], "job_id string, record_id string"))
    s.vacuum()
    assert keys(s) == [("j1", "r1", None), ("j1", "r2", None), ("j2", "r2", 0)]


def test_a_change_rewrites_its_buckets_only(spark):
    s = VectorStore(spark, buckets=8)
    rows = [("p", job, f"r{i}", None, [float(i), 1.0]) for job in ("j1", "j2:[a]*%") for i in range(200)]
    s.append(spark.createDataFrame(rows, SCHEMA))
    first = s.slices()
    assert len(first) == 16
    s.upsert(spark.createDataFrame([("p", "j2:[a]*%", "r7", None, [5.0, 5.0])], SCHEMA))
    gone = first - s.slices()
    assert len(gone) == 1 and {job for job, _, _ in gone} == {"j2:[a]*%"}
    assert s.vectors().count() == 400
    assert [list(r["vector"]) for r in s.vectors("j2:[a]*%").filter("record_id = 'r7'").collect()] == [[5.0, 5.0]]
    # a store that is opened again keeps its number of buckets; its plan opens the named job's files only
    again = VectorStore(spark, s.root)
    assert again.buckets == 8
    assert all("job_id=j1" in f for f in again.vectors("j1").inputFiles())
    n_files = len(s.vectors().inputFiles())
    s.upsert(spark.createDataFrame([], SCHEMA))
    s.delete_records(spark.createDataFrame([("no job", "r1")], "job_id string, record_id string"))
    assert len(s.vectors().inputFiles()) == n_files


def test_null_ids_are_stored_and_read_back(spark):
    s = make(spark)
    s.append(spark.createDataFrame([(None, None, None, None, [1.0])], SCHEMA))
    assert s.vectors().filter("job_id is null and record_id is null").count() == 1
    s.delete_records(spark.createDataFrame([("j2", "r1"), (None, None)], "job_id string, record_id string"))
    assert s.vectors().count() == 4 and s.vectors().filter("job_id is null").count() == 1   # null equals nothing


def wide_units(spark, n=40, words=300):
    """Units of their own words each: vectors ``n * words`` wide with ``words`` entries; the last two are empty."""
    rows = [("j", str(i), None, " ".join(f"w{i}x{k}" for k in range(words))) for i in range(n)]
    return spark.createDataFrame(rows + [("j", "e", None, ""), ("j", "f", None, None)],
                                 "job_id string, record_id string, sub_key int, text string")


def test_wide_count_vectors_are_kept_compact(spark):
    import os

    from tessera.operators import count_embed
    from tessera.schema import BOW
    units = wide_units(spark)
    model = count_embed.fit(units, BOW)
    vocab = {r["position"]: r["term"] for r in model.vocab().collect()}
    s = VectorStore(spark)
    s.append(model.compact(units).withColumn("project_id", F.lit("p")))
    kept = {r["record_id"]: r for r in s.rows().collect()}
    assert len(kept["3"]["vector"]) == len(kept["3"]["positions"]) == 300 and kept["3"]["width"] == 12000
    assert kept["e"]["positions"] == [] and kept["f"]["width"] == 12000
    s.export()
    s.build_collection(lsh_buckets=3)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(s.exports_path) for f in names)
    assert size < 42 * 12000            # lists of all values would have 4 characters each, compressed or not
    dense = {r["record_id"]: list(r["vector"]) for r in model.dense(units).collect()}
    for frame in (s.vectors(), s.read_export()):
        assert {r["record_id"]: list(r["vector"]) for r in frame.collect()} == dense
    for r, v in dense.items():
        assert len(v) == 12000 and {vocab[i] for i, x in enumerate(v) if x} == ({f"w{r}x{k}" for k in range(300)} if r not in "ef" else set())
    found = {r["record_id"]: r for r in s.collection().collect()}
    assert abs(sum(x * x for x in found["3"]["unit"]) - 1) < 1e-9 and len(found["3"]["unit"]) == 12000
    from tessera.operators.knn import hyperplane_signature
    again = s.collection().withColumn("b", hyperplane_signature(F.col("unit"), 3, 7))
    assert again.where("b <> bucket").count() == 0
    s.delete_records(spark.createDataFrame([("j", "3")], "job_id string, record_id string"))
    assert s.rows().count() == 41 and len(s.vectors().where("record_id = '4'").first()["vector"]) == 12000


def test_compact_rows_of_a_repeated_unit(spark):
    from tessera.operators import count_embed
    from tessera.schema import BOC
    units = spark.createDataFrame([("j", "a", None, "xyz"), ("j", "a", None, "xyz"), ("j", "b", 1, "z" * 9 + "abcdefgh")],
                                  "job_id string, record_id string, sub_key int, text string")
    got = sorted((r["record_id"], list(r["vector"])) for r in count_embed.fit(units, BOC).dense(units).collect())
    assert got == [("a", [0.0] * 8 + [1.0, 1.0, 1.0])] * 2 + [("b", [1.0] * 8 + [0.0, 0.0, 9.0])]
