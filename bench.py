"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is executed fully (noop sink: every row produced, nothing collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["boc_embed", "tfidf_embed", "bow_pca_embed", "vector_upsert", "knn_topk",
            "hashed_embed", "model_embed", "throttle_by_key"]


def _warm_up(spark, sf_dir: str) -> None:
    import pandas as pd
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("source", "text")
    docs.groupBy("source").agg(F.count(F.lit(1))).collect()

    def ident(it):
        for pdf in it:
            yield pd.DataFrame({"n": pdf["source"].str.len()})
    docs.limit(100).mapInPandas(ident, "n long").collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from tessera.plans.queries import QUERIES
    from tessera.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, int(cpus) * 2))
    # untimed warm-up (JVM code generation, Python workers); its time is reported separately
    t0 = time.time()
    _warm_up(spark, sf_dir)
    warmup = round(time.time() - t0, 3)
    timings: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
        rows[name] = df.count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_wall_time", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "rows": rows, "warmup_sec": warmup, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
