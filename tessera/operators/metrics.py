"""Counts, progress, warnings, failures and job-state reports.

All are grouped aggregates (partial aggregation before the shuffle, so a hot
job or project is combined map-side) and joins of small per-job results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import ordinal_within
from ..schema import (DOC_BATCH, DOCUMENT_IS_SPLITTED, EMBEDDING_LIST, EXAMPLE_WITH_ID, EXAMPLE_WITH_PK,
                      MSG_AZURE_KEY, MSG_COHERE_TOKEN, MSG_OPENAI_KEY, MSG_RUNTIME, TOKEN_MISMATCHING,
                      WARNING_TEMPLATES)


def unit_count(units: DataFrame, group: str = "project_id") -> DataFrame:
    """Expected units per project: records, or list entries for a list attribute."""
    return units.groupBy(group).agg(F.count(F.lit(1)).alias("expected"))


def unit_count_by_type(attributes: DataFrame, records: DataFrame, entries: DataFrame) -> DataFrame:
    """Expected units of each attribute: list entries for a list attribute, records for any other.

    ``attributes(project_id, name, data_type)``, ``records`` and ``entries`` one row per
    record and per list entry; a project without rows expects 0.
    """
    n_records = records.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_records"))
    n_entries = entries.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_entries"))
    j = attributes.join(n_records, "project_id", "left").join(n_entries, "project_id", "left")
    expected = F.when(F.col("data_type") == EMBEDDING_LIST, F.col("n_entries")).otherwise(F.col("n_records"))
    return j.select("project_id", "name", F.coalesce(expected, F.lit(0)).cast("long").alias("expected"))


def vector_count(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_vectors"))


def progress_value(state, n_vectors, expected):
    """0.1 unless INITIALIZING, plus n/expected*0.9, capped at 0.99; 0 expected adds nothing."""
    base = F.when(state != "INITIALIZING", F.lit(0.1)).otherwise(F.lit(0.0))
    part = F.when(expected > 0, n_vectors / expected * 0.9).otherwise(F.lit(0.0))
    return F.least(F.lit(0.99), base + part)


def progress(states: DataFrame, vectors: DataFrame, expected: DataFrame) -> DataFrame:
    """Progress of each job from its state, its stored vectors and its expected units.

    ``states(job_id, state)``, ``vectors`` with job_id, ``expected(job_id, expected)``;
    missing counts are 0.
    """
    j = states.join(vector_count(vectors), "job_id", "left").join(expected, "job_id", "left") \
        .fillna(0, ["n_vectors", "expected"])
    p = progress_value(F.col("state"), F.col("n_vectors"), F.col("expected"))
    return j.select("job_id", "state", "n_vectors", "expected", F.round(p, 6).alias("progress"))


def progress_by_batch(expected: DataFrame, batch_size: int = DOC_BATCH) -> DataFrame:
    """Progress reported after each batch write of an encoding run.

    (job_id, batch, n_vectors, progress); batch -1 is the message sent when
    encoding starts, before any vector is written.
    """
    n_batches = F.ceil(F.col("expected") / F.lit(batch_size)).cast("int")
    b = expected.select("job_id", "expected",
                        F.explode(F.sequence(F.lit(-1), n_batches - 1)).alias("batch"))
    n = F.least((F.col("batch") + 1) * batch_size, F.col("expected")).cast("long")
    return b.select("job_id", "batch", n.alias("n_vectors"),
                    F.round(progress_value(F.lit("ENCODING"), n, F.col("expected")), 6).alias("progress"))


def tokenization_progress(records: DataFrame, tokens: DataFrame) -> DataFrame:
    """Share of each project's records that have tokens; null progress means done (the gate opens)."""
    tokenized = tokens.select("project_id", "record_id").distinct()
    r = records.select("project_id", "record_id")
    done = r.join(tokenized, ["project_id", "record_id"], "left_semi").groupBy("project_id") \
        .agg(F.count(F.lit(1)).alias("n_tokenized"))
    total = r.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_records"))
    out = total.join(done, "project_id", "left").fillna(0, ["n_tokenized"])
    p = F.col("n_tokenized") / F.col("n_records")
    return out.select("project_id", "n_records", "n_tokenized",
                      F.when(p < 1, F.round(p, 6)).alias("progress"),
                      (p >= 1).alias("ready"))


def batch_plan(units: DataFrame, batch_size: int = DOC_BATCH) -> DataFrame:
    """Batch number of each unit inside its job, in (record_id, sub_key) order."""
    ranked = ordinal_within(units.select("job_id", "record_id", "sub_key"), ["job_id"],
                            ["record_id", "sub_key"], "pos")
    return ranked.select("job_id", "record_id", "sub_key", "pos",
                         F.floor(F.col("pos") / batch_size).cast("long").alias("batch"))


def job_latest_state(events: DataFrame) -> DataFrame:
    """Current state per job: the state of its latest (ts, event_id)."""
    return events.groupBy("job_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"),
        F.max("ts").alias("ts"))


def failure_message(platform, error_class, error_text):
    return (F.when(error_class == "connection", error_text)
            .when(error_class.isin("invalid_key", "not_found") & (platform == "openai"), F.lit(MSG_OPENAI_KEY))
            .when(error_class.isin("invalid_key", "not_found") & (platform == "azure"), F.lit(MSG_AZURE_KEY))
            .when(error_class == "invalid_token", F.lit(MSG_COHERE_TOKEN))
            .otherwise(F.lit(MSG_RUNTIME)))


def failure_report(events: DataFrame) -> DataFrame:
    """Jobs whose latest state is FAILED, with the short message for their platform and error."""
    latest = events.groupBy("job_id").agg(
        F.max_by(F.struct("state", "platform", "error_class", "ts", "event_id"),
                 F.struct("ts", "event_id")).alias("l"))
    failed = latest.filter(F.col("l.state") == "FAILED")
    text = F.concat(F.lit("connection failed at event "), F.col("l.event_id").cast("string"))
    return failed.select("job_id", F.col("l.platform").alias("platform"),
                         F.col("l.error_class").alias("error_class"),
                         failure_message(F.col("l.platform"), F.col("l.error_class"), text).alias("message"),
                         F.col("l.ts").alias("failed_at"))


def cancel_cut(events: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Per job: batch writes (ENCODING events) before the first FAILED event stay, later ones are cut.

    ``removed(job_id, ts)``: jobs deleted while they were encoding; their removal cuts like a failure.
    """
    first_failed = events.filter(F.col("state") == "FAILED").groupBy("job_id") \
        .agg(F.min("ts").alias("first_failed"))
    if removed is not None:
        first_failed = first_failed.unionByName(removed.select("job_id", F.col("ts").alias("first_failed"))) \
            .groupBy("job_id").agg(F.min("first_failed").alias("first_failed"))
    writes = events.filter(F.col("state") == "ENCODING").select("job_id", "ts")
    j = writes.join(first_failed, "job_id", "left")
    kept = F.col("first_failed").isNull() | (F.col("ts") < F.col("first_failed"))
    return j.groupBy("job_id").agg(
        F.sum(kept.cast("long")).alias("kept_batches"),
        F.sum((~kept).cast("long")).alias("cut_batches"),
        F.first("first_failed").alias("first_failed"))


def get_warnings(embedded: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(job_id, record_id, warning_type) of embedded units (the output of ``model_embed``).

    A unit of more than one part was split. With ``tokens(job_id, record_id)``, one row a token,
    records whose number of vectors differs are mismatching.
    """
    split = embedded.filter(F.col("n_parts") > 1).select("job_id", "record_id").distinct() \
        .withColumn("warning_type", F.lit(DOCUMENT_IS_SPLITTED))
    if tokens is None:
        return split
    have = embedded.filter(F.col("vector").isNotNull()).select(F.col("job_id").alias("project_id"), "record_id")
    want = tokens.select(F.col("job_id").alias("project_id"), "record_id")
    other = token_mismatch(want, have).select(F.col("project_id").alias("job_id"), "record_id",
                                              F.lit(TOKEN_MISMATCHING).alias("warning_type"))
    return split.unionByName(other)


def vector_count_check(changes: DataFrame, new_vectors: DataFrame) -> DataFrame:
    """Per job: number of changes vs number of new vectors; ``ok`` false fails the job."""
    c = changes.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_changes"))
    v = new_vectors.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    j = c.join(v, "job_id", "full_outer").fillna(0, ["n_changes", "n_vectors"])
    return j.select("job_id", "n_changes", "n_vectors", (F.col("n_changes") == F.col("n_vectors")).alias("ok"))


def token_mismatch(tokens: DataFrame, token_vectors: DataFrame) -> DataFrame:
    """Records whose number of token vectors differs from their number of tokens."""
    t = tokens.groupBy("project_id", "record_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    v = token_vectors.groupBy("project_id", "record_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    j = t.join(v, ["project_id", "record_id"], "full_outer").fillna(0, ["n_tokens", "n_vectors"])
    return j.filter(F.col("n_tokens") != F.col("n_vectors"))


def _template(wtype: str) -> str:
    return WARNING_TEMPLATES[wtype].replace("{record_number}", "%s").replace("{example_record_msg}", "%s")


def warning_report(warnings: DataFrame, records_data: DataFrame, attributes: DataFrame) -> DataFrame:
    """One message per (project, warning type): count of records, the last one as example.

    ``warnings(project_id, record_id, warning_type, pos)``;
    ``records_data(project_id, record_id, data map<string,string>)``;
    ``attributes(project_id, name, is_primary_key, …)``. The example shows the
    primary-key values (in attribute-name order) or the record id when the
    project has no primary key.
    """
    agg = warnings.groupBy("project_id", "warning_type").agg(
        F.countDistinct("record_id").alias("record_number"),
        F.max_by("record_id", F.struct("pos", "record_id")).alias("example_record_id"))
    pks = attributes.filter(F.col("is_primary_key")).groupBy("project_id").agg(
        F.array_sort(F.collect_list("name")).alias("pk_names"))
    ex = (agg.join(pks, "project_id", "left")
          .join(records_data.withColumnRenamed("record_id", "example_record_id"),
                ["project_id", "example_record_id"], "left"))
    pk_vals = F.array_join(F.transform("pk_names", lambda n: F.element_at(F.col("data"), n)), ", ")
    example = F.when(F.size(F.coalesce("pk_names", F.array())) > 0, F.concat(F.lit(EXAMPLE_WITH_PK), pk_vals)) \
        .otherwise(F.concat(F.lit(EXAMPLE_WITH_ID), F.col("example_record_id")))
    msg = None
    for wtype in WARNING_TEMPLATES:
        m = F.format_string(_template(wtype), F.col("record_number").cast("string"), example)
        msg = F.when(F.col("warning_type") == wtype, m) if msg is None else msg.when(F.col("warning_type") == wtype, m)
    return ex.select("project_id", "warning_type", "record_number", "example_record_id", msg.alias("message"))


__all__ = ["unit_count", "unit_count_by_type", "vector_count", "progress", "progress_value", "progress_by_batch",
           "get_warnings",
           "tokenization_progress", "batch_plan", "job_latest_state", "failure_report", "cancel_cut",
           "vector_count_check", "token_mismatch", "warning_report"]
