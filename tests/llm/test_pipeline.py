import corpus_pipeline as P
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_packing import check as packed
from test_simhash import brute as copies
from test_suffixes import brute as repeats

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in P.STAGES[:-1]:
        before = rows(docs)
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        after = rows(docs)
        if name == "language_id":
            assert sorted(after) == sorted((d, t) for d, t in before if t and any(c.isalpha() for c in t))
        elif name == "simhash_near_dedup":
            assert sorted(d for d, _ in after) == sorted({r[2] for r in copies(before)})
        elif name == "suffix_array_dedup":
            left = {r[0]: r[1] - r[2] for r in repeats(before)}
            assert {d for d, _ in after} == {d for d, n in left.items() if n}
            assert all(left[d] - 8 * len(t) // 100 - 8 <= len(t.encode()) <= left[d] for d, t in after)
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        else:
            assert sorted(d for d, _ in after) == sorted(r[0] for r in leaks(before, items) if not r[-1])
    packed(P.STAGES[-1][1](spark, docs, SMALL).collect(), rows(docs))


def test_run_and_edge_rows(spark, doc_rows):
    assert P.run(spark, SMALL).count() > 0
    assert P.ORACLE_SQL is None and "pipeline" in entry.queries()
    docs = doc_rows.withColumn("lang", F.coalesce("lang", F.lit("en"))).withColumn("fp", F.lit(1)).withColumn("pack", F.lit("x"))
    for start in (docs, docs.limit(0)):
        frame = start
        for _, stage in P.STAGES:
            frame = stage(spark, frame, SMALL)
        assert frame.count() >= 0
