"""Job streams: latest state per job, token gate, re-embedding and scoring of arriving data.

All streams here are Structured Streaming queries; the registered queries run
them with ``trigger(availableNow=True)`` and read the sink back, so the stream
result can be compared with the batch operator on the same input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import from_micros, micros
from ..operators import count_embed
from ..schema import TOKEN_WAIT_CHECKS, TOKEN_WAIT_SECONDS
from ..session import create_marker, fresh_path, path_exists
from ..sinks.vector_store import VectorStore


def run_available(query_builder, checkpoint: str, trigger: dict | None = None):
    """Start a stream and wait for it, return nothing (sinks are read back).

    ``trigger`` holds the arguments of ``trigger()``, availableNow by default. The same
    ``checkpoint`` given again goes on where the last run stopped.
    """
    q = query_builder.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def job_state_stream(spark: SparkSession, events_stream: DataFrame, out_path: str,
                     checkpoint: str | None = None, trigger: dict | None = None) -> None:
    """Latest state per job, maintained by a streaming aggregation (state store), written per batch.

    Each micro-batch writes the states of the jobs it changed as version ``batch_id`` below
    ``out_path`` (rerunning a batch replaces its own version only), so readers never see a
    table that is being rewritten; :func:`current_job_states` reads the newest of each job.
    """
    latest = events_stream.groupBy("job_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(out_path))

    run_available(latest.writeStream.outputMode("update").foreachBatch(write),
                  checkpoint or fresh_path(spark, "ckpt-job-state"), trigger)


def current_job_states(spark: SparkSession, out_path: str) -> DataFrame:
    """(job_id, state, ts) of the newest version of each job."""
    v = spark.read.parquet(out_path)
    return v.groupBy("job_id").agg(F.max_by("state", "version").alias("state"), F.max_by("ts", "version").alias("ts"))


def token_gate(events: DataFrame, wait_seconds: int = TOKEN_WAIT_SECONDS,
               checks: int = TOKEN_WAIT_CHECKS) -> DataFrame:
    """Token jobs waiting for tokenisation: proceed at the first check that finds it ready, else fail.

    A job enters WAITING at its first WAITING event (t0); tokenisation is ready at
    the job's first ENCODING event after t0. Checks run every ``wait_seconds``;
    ready at check c < ``checks`` lets the job proceed at t0 + c·wait; the
    ``checks``-th check fails whatever it finds (t0 + checks·wait).
    """
    w = events.filter(F.col("state") == "WAITING").groupBy("job_id").agg(F.min("ts").alias("t0"))
    ready = (events.filter(F.col("state") == "ENCODING").select("job_id", F.col("ts").alias("rts"))
             .join(w, "job_id").filter(F.col("rts") > F.col("t0"))
             .groupBy("job_id").agg(F.min("rts").alias("ready_at")))
    j = w.join(ready, "job_id", "left")
    us = micros
    step = wait_seconds * 1_000_000
    c = F.ceil((us("ready_at") - us("t0")) / F.lit(step)).cast("long")
    ok = F.col("ready_at").isNotNull() & (c < checks)
    decided_us = F.when(ok, us("t0") + c * step).otherwise(us("t0") + checks * step)
    return j.select("job_id", "t0", "ready_at",
                    F.when(ok, F.lit("ENCODING")).otherwise(F.lit("FAILED")).alias("outcome"),
                    F.when(ok, c).otherwise(F.lit(checks).cast("long")).alias("checks"),
                    from_micros(decided_us).alias("decided_at"))


def re_embed_stream(spark: SparkSession, store: VectorStore, change_dir: str, records: DataFrame,
                    model: str | None = None, checkpoint: str | None = None, trigger: dict | None = None,
                    list_records: DataFrame | None = None, tokens: DataFrame | None = None, provider=None,
                    export: bool = True) -> None:
    """Change sets arriving as JSON text files; each micro-batch is re-embedded and upserted, exactly once.

    ``model``, ``list_records``, ``tokens``, ``provider`` and ``export`` are those of ``plans.jobs.re_embed``.
    A batch that is finished is noted in the store's ledger, under its checkpoint and number; Spark may hand it in
    again after a crash, and then nothing is read or written. A batch that broke off before is run
    again: its vectors, exports and checks replace what it left. The checks of each batch lie below
    ``re_embed_checks`` (see :func:`re_embed_checks`).
    """
    checkpoint = checkpoint or fresh_path(spark, "ckpt-re-embed")
    stream = spark.readStream.format("text").load(change_dir)
    run = re_embed_batch(spark, store, checkpoint, records, model, list_records, tokens, provider, export)
    run_available(stream.writeStream.foreachBatch(run), checkpoint, trigger)


def re_embed_batch(spark: SparkSession, store: VectorStore, checkpoint: str, records: DataFrame, model: str | None = None,
                   list_records: DataFrame | None = None, tokens: DataFrame | None = None, provider=None,
                   export: bool = True):
    """The function of (batch, batch_id) that :func:`re_embed_stream` runs for each micro-batch."""
    from ..plans.jobs import built_in, re_embed

    stream_id = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def apply(batch: DataFrame, batch_id: int) -> None:
        done = f"{store.root}/ledger/{stream_id}/{batch_id}"
        if path_exists(spark, done):
            return
        if batch.limit(1).count():
            fixed = fresh_path(spark, f"changes-batch-{batch_id}")
            batch.write.text(fixed)
            check = re_embed(store, spark.read.text(fixed), records, model, list_records, tokens, provider or built_in, export)
            (check.select("job_id", "n_changes", "n_vectors", "ok").write.mode("overwrite")
             .parquet(f"{store.root}/re_embed_checks/stream={stream_id}/batch={batch_id}"))
        create_marker(spark, done)

    return apply


def re_embed_checks(store: VectorStore) -> DataFrame:
    """(stream, batch, job_id, n_changes, n_vectors, ok) of every finished batch."""
    schema = "job_id string, n_changes long, n_vectors long, ok boolean, stream string, batch long"
    path = f"{store.root}/re_embed_checks"
    if not path_exists(store.spark, path):
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).parquet(path)


def score_stream(spark: SparkSession, model: count_embed.CountModel, texts_stream: DataFrame, job_id: str,
                 out_path: str, checkpoint: str | None = None, trigger: dict | None = None) -> None:
    """Ad-hoc texts scored as they arrive with a saved model (stream-static, no refit)."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        units = batch.select(F.lit(job_id).alias("job_id"), F.col("item_id").cast("string").alias("record_id"),
                             F.lit(None).cast("int").alias("sub_key"), "text")
        out = model.transform(units).withColumn("batch_id", F.lit(batch_id))
        # overwrite this batch's slice only: a replayed batch replaces itself
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_path))

    run_available(texts_stream.writeStream.foreachBatch(apply), checkpoint or fresh_path(spark, "ckpt-score"), trigger)
