"""Job-side tables derived from the given data: jobs, attributes, job events.

* jobs: every project (``documents.source``) asks for every catalog model at
  both levels, plus a few requests the dispatch must reject; the job id is
  ``project:type:platform:model``.
* attributes: each document project has ``doc_id`` (primary key), ``text``,
  ``lang``; the conversations project has a list attribute ``turns`` and no
  primary key.
* job events: ``events`` rows are state changes of job ``user_id``; event types
  map to states (view INITIALIZING, click WAITING, signup ENCODING, purchase
  FINISHED, error FAILED). ``props.k`` picks the provider error class of a
  failure and ``user_id`` the job's platform.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ERROR_CLASSES, MODEL_CATALOG, ON_ATTRIBUTE, ON_TOKEN, PLATFORMS
from .records import load

# Requests outside the catalog that the dispatch must handle (engine test input).
EXTRA_REQUESTS = [("python", "word2vec"), ("unknown-platform", "some-model"),
                  ("azure", "text-embedding-3-small"), ("cohere", "embed-english")]

EVENT_STATES = [("view", "INITIALIZING"), ("click", "WAITING"), ("signup", "ENCODING"),
                ("purchase", "FINISHED"), ("error", "FAILED")]


def _requests_array():
    reqs = [(p, m) for (m, _, _, _, p) in MODEL_CATALOG] + EXTRA_REQUESTS
    return F.array(*[F.struct(F.lit(t).alias("type"), F.lit(p).alias("platform"), F.lit(m).alias("model"))
                     for t in (ON_ATTRIBUTE, ON_TOKEN) for (p, m) in reqs])


def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, n_records, lang): record count and most frequent language per project."""
    docs = load(spark, sf_dir, "documents")
    per_lang = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return per_lang.groupBy(F.col("source").alias("project_id")).agg(
        F.sum("n").alias("n_records"),
        F.max_by("lang", F.struct(F.col("n"), F.col("lang"))).alias("lang"))


def jobs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jobs(job_id, project_id, attribute_id, name, type, platform, model) for every project."""
    projects = load(spark, sf_dir, "documents").select(F.col("source").alias("project_id")).distinct()
    j = projects.select("project_id", F.explode(_requests_array()).alias("r")).select(
        "project_id", "r.type", "r.platform", "r.model")
    job_id = F.concat_ws(":", "project_id", "type", "platform", "model")
    return j.select(job_id.alias("job_id"), "project_id", F.lit("text").alias("attribute_id"),
                    F.concat_ws("-", "model", "type").alias("name"), "type", "platform", "model")


def attributes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = load(spark, sf_dir, "documents").select(F.col("source").alias("project_id")).distinct()
    attrs = F.array(
        F.struct(F.lit("doc_id").alias("name"), F.lit("INTEGER").alias("data_type"), F.lit(True).alias("pk")),
        F.struct(F.lit("text").alias("name"), F.lit("TEXT").alias("data_type"), F.lit(False).alias("pk")),
        F.struct(F.lit("lang").alias("name"), F.lit("CATEGORY").alias("data_type"), F.lit(False).alias("pk")))
    return projects.select("project_id", F.explode(attrs).alias("a")).select(
        "project_id", F.col("a.name").alias("attribute_id"), F.col("a.name").alias("name"),
        F.col("a.data_type").alias("data_type"), F.col("a.pk").alias("is_primary_key"))


def state_of(event_type):
    expr = None
    for et, st in EVENT_STATES:
        expr = (F.when(event_type == et, F.lit(st)) if expr is None
                else expr.when(event_type == et, F.lit(st)))
    return expr


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_events(event_id, job_id, ts, state, platform, error_class)."""
    return job_events_from(load(spark, sf_dir, "events"))


def job_events_from(ev: DataFrame) -> DataFrame:
    """The job-event view of an ``events`` frame (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("int")
    err = F.element_at(F.array(*[F.lit(c) for c in ERROR_CLASSES]), F.pmod(k, F.lit(len(ERROR_CLASSES))) + 1)
    plat = F.element_at(F.array(*[F.lit(p) for p in PLATFORMS]),
                        (F.pmod(F.col("user_id"), F.lit(len(PLATFORMS))) + 1).cast("int"))
    return ev.select("event_id", F.col("user_id").cast("string").alias("job_id"), "ts",
                     state_of(F.col("event_type")).alias("state"),
                     plat.alias("platform"), err.alias("error_class"))
