"""Which saved embedder made each job's vectors: rows appended below the store's root, the last of a job counts.

A row names the job's level, provider and batch size, and in ``saved`` the model tables its
vectors come from: a count model, ``REDUCED_BOW``, ``MODEL_PCA`` (the components of a model's
vectors), or null for a model whose vectors are stored as they come. Weights and keys of model
functions are not saved; the caller's provider makes the function anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

EMBEDDER = ["project_id", "type", "platform", "model", "batch_size", "saved"]
SCHEMA = ("job_id string, project_id string, type string, platform string, model string, batch_size int, "
          "saved string, removed boolean, ts timestamp")


def _append(rows: DataFrame, root: str) -> None:
    rows.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(f"{root}/embedders")


def register(root: str, jobs: DataFrame, saved: str | None) -> None:
    """``jobs`` (job_id, project_id, type, platform, model, batch_size) have vectors of the tables ``saved``."""
    _append(jobs.select("job_id", *EMBEDDER[:-2], F.col("batch_size").cast("int"), F.lit(saved).cast("string").alias("saved"),
                        F.lit(False).alias("removed")), root)


def unregister(spark: SparkSession, root: str, job_id: str) -> None:
    nothing = [F.lit(None).cast("int" if c == "batch_size" else "string").alias(c) for c in EMBEDDER]
    _append(spark.range(1).select(F.lit(job_id).alias("job_id"), *nothing, F.lit(True).alias("removed")), root)


def embedders(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, project_id, type, platform, model, batch_size, saved) of every job that has an embedder."""
    path = f"{root}/embedders"
    rows = spark.read.schema(SCHEMA).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], SCHEMA)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*EMBEDDER, "removed"), "ts").alias("e"))
    return last.filter(~F.col("e.removed")).select("job_id", *[F.col(f"e.{c}").alias(c) for c in EMBEDDER])
