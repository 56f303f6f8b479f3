import json

from pyspark.sql import functions as F

from tessera.sources import records as src


def test_list_units_from_arrays_edges(spark):
    rows = [("p", "r_null", None), ("p", "r_empty", []), ("p", "r_one", ["a"]),
            ("p", "r_null_entry", ["x", None]), ("p", "r_three", ["u", "v", "w"])]
    df = spark.createDataFrame(rows, "project_id string, record_id string, texts array<string>")
    got = sorted((r["record_id"], r["sub_key"], r["unit_key"], r["text"])
                 for r in src.list_units_from_arrays(df).collect())
    assert got == [("r_null_entry", 0, "r_null_entry@0", "x"), ("r_null_entry", 1, "r_null_entry@1", None),
                   ("r_one", 0, "r_one@0", "a"),
                   ("r_three", 0, "r_three@0", "u"), ("r_three", 1, "r_three@1", "v"),
                   ("r_three", 2, "r_three@2", "w")]


def test_change_scan_mixed_duplicates_and_unknown_job(spark):
    reqs = [{"j1": [{"record_id": "r1", "attribute_name": "text"},
                    {"record_id": "r1", "attribute_name": "text"},
                    {"record_id": "r2", "attribute_name": "turns", "sub_key": "0"},
                    {"record_id": "r2", "attribute_name": "turns", "sub_key": "3"}],
             "unknown": [{"record_id": "r9", "attribute_name": "text"}],
             "empty": []}]
    df = spark.createDataFrame([(json.dumps(r),) for r in reqs], "value string")
    ch = src.change_scan(df)
    rows = sorted((r["job_id"], r["record_id"], r["sub_key"]) for r in ch.collect())
    assert rows == [("j1", "r1", None), ("j1", "r1", None), ("j1", "r2", 0), ("j1", "r2", 3),
                    ("unknown", "r9", None)]
    jobs = spark.createDataFrame([("j1",)], "job_id string")
    kept = ch.dropDuplicates(["job_id", "record_id", "sub_key"]).join(jobs, "job_id")
    assert sorted((r["record_id"], r["sub_key"]) for r in kept.collect()) == \
        [("r1", None), ("r2", 0), ("r2", 3)]


def test_unit_key_round_trip(spark):
    df = spark.createDataFrame([("r1", None), ("r2", 0), ("r3", 12)], "record_id string, sub_key int")
    keyed = df.withColumn("unit_key", src.unit_key("record_id", "sub_key"))
    back = src.parse_unit_key(keyed.select(F.col("unit_key")))
    assert sorted((r["unit_key"], r["record_id"], r["sub_key"]) for r in back.collect()) == \
        [("r1", "r1", None), ("r2@0", "r2", 0), ("r3@12", "r3", 12)]
