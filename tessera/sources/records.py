"""Scans: records, attribute units, list-attribute units, lookups, tokens, changes.

Mapping of the given tables onto the engine's data model:
  documents      records of several projects; ``source`` is the project,
                 ``text`` the text attribute, ``lang`` the project language
  conversations  one list attribute per conversation: its texts in ``turn``
                 order, entries addressed by a 0-based ``sub_key``
  embeddings     stored vectors (64 wide)
  events         job events and throttle input
  labels         the records that were edited (change sets)
  benchmark      ad-hoc texts to score
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indexing import ordinal_within
from ..functions.text import tokenize
from ..schema import CHANGE_SET

TEXT_ATTRIBUTE = "text"
LIST_ATTRIBUTE = "turns"
CONVERSATION_PROJECT = "conversations"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records(project_id, record_id, text, lang): one row per document."""
    return load(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"),
        F.col("doc_id").cast("string").alias("record_id"),
        "text", "lang")


def attribute_scan(records: DataFrame, attribute: str = TEXT_ATTRIBUTE) -> DataFrame:
    """All (project, record, text) pairs of one attribute; only that column is read."""
    return records.select("project_id", "record_id", F.col(attribute).alias("text"))


def job_units(records: DataFrame, attribute: str = TEXT_ATTRIBUTE, job_col: str = "project_id") -> DataFrame:
    """units(job_id, record_id, sub_key, text) of one job per project."""
    return records.select(F.col(job_col).alias("job_id"), "record_id",
                          F.lit(None).cast("int").alias("sub_key"), F.col(attribute).alias("text"))


def list_units_from_arrays(records_list: DataFrame, list_col: str = "texts") -> DataFrame:
    """One unit per list entry of an array attribute: ``posexplode`` keeps the 0-based position.

    An empty or null list gives no unit; a null entry gives a unit with null text.
    """
    return (records_list.select("project_id", "record_id",
                                F.posexplode_outer(list_col).alias("sub_key", "text"))
            .filter(F.col("sub_key").isNotNull())
            .withColumn("sub_key", F.col("sub_key").cast("int"))
            .withColumn("unit_key", unit_key("record_id", "sub_key")))


def list_units_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List attribute stored as rows (conversations): sub_key = rank of ``turn``.

    The rank comes from :func:`ordinal_within`, which never puts a whole
    conversation into one task.
    """
    conv = load(spark, sf_dir, "conversations").select(
        F.lit(CONVERSATION_PROJECT).alias("project_id"),
        F.col("conv_id").cast("string").alias("record_id"), "turn", "text")
    ranked = ordinal_within(conv, ["project_id", "record_id"], ["turn"], "sub_key")
    return (ranked.withColumn("sub_key", F.col("sub_key").cast("int"))
            .withColumn("unit_key", unit_key("record_id", "sub_key"))
            .select("project_id", "record_id", "sub_key", "unit_key", "text"))


def unit_key(record_id: str, sub_key: str):
    """``record_id`` or ``record_id@sub_key`` for a list entry."""
    return F.when(F.col(sub_key).isNull(), F.col(record_id)) \
            .otherwise(F.concat_ws("@", F.col(record_id), F.col(sub_key).cast("string")))


def parse_unit_key(df: DataFrame, col: str = "unit_key") -> DataFrame:
    parts = F.split(F.col(col), "@")
    return (df.withColumn("record_id", parts.getItem(0))
              .withColumn("sub_key", F.when(F.size(parts) > 1, parts.getItem(1).cast("int"))))


def record_lookup(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose (project_id, record_id) is in ``ids`` (a semi join on distinct ids).

    Spark plans the semi join as a broadcast when the id side is small at
    runtime (AQE) and as a shuffled join otherwise.
    """
    return records.join(ids.select("project_id", "record_id").distinct(),
                        ["project_id", "record_id"], "left_semi")


def tokens_table(records: DataFrame, attribute: str = TEXT_ATTRIBUTE) -> DataFrame:
    """tokens(project_id, record_id, attribute, token_idx, token)."""
    return records.select("project_id", "record_id", F.col(attribute).alias("_t")).select(
        "project_id", "record_id", F.lit(attribute).alias("attribute"),
        F.posexplode(F.regexp_extract_all(F.lower("_t"), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("token_idx", "token")
    ).withColumn("token_idx", F.col("token_idx").cast("int"))


def token_scan(tokens: DataFrame, attribute: str, ids: DataFrame | None = None) -> DataFrame:
    """Tokens of one attribute (filter pushed to the scan), optionally only for ``ids``."""
    t = tokens.filter(F.col("attribute") == attribute)
    if ids is not None:
        t = t.join(ids.select("project_id", "record_id").distinct(), ["project_id", "record_id"], "left_semi")
    return t


def require_all_found(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` missing from ``found`` (an order-preserving lookup must find all)."""
    return wanted.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def change_scan(change_json: DataFrame, col: str = "value") -> DataFrame:
    """Change sets (JSON text, one request per row) to rows.

    (job_id, record_id, attribute_name, sub_key int). ``sub_key`` arrives as text.
    """
    parsed = change_json.select(F.from_json(F.col(col), CHANGE_SET).alias("cs"))
    per_job = parsed.select(F.explode("cs").alias("job_id", "entries"))
    return per_job.select("job_id", F.explode("entries").alias("e")).select(
        "job_id", F.col("e.record_id").alias("record_id"),
        F.col("e.attribute_name").alias("attribute_name"),
        F.col("e.sub_key").cast("int").alias("sub_key"))


def changes_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-set requests derived from the data: every labelled document was edited.

    One JSON request per edited record, keyed by its project's job.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    labelled = docs.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    entry = F.struct(F.col("doc_id").cast("string").alias("record_id"),
                     F.lit(TEXT_ATTRIBUTE).alias("attribute_name"))
    return labelled.select(F.to_json(F.create_map(F.col("source"), F.array(entry))).alias("value"))


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New record contents for the edited (labelled) documents: the text reversed."""
    docs = documents_records(spark, sf_dir)
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("record_id"))
    return (docs.join(labels, "record_id", "left_semi")
                .withColumn("text", F.reverse("text")))


def vector_scan_ordered(vectors: DataFrame, job_id: str | None = None) -> DataFrame:
    """Vectors of one job (partition filter) in (record_id, sub_key) order."""
    v = vectors if job_id is None else vectors.filter(F.col("job_id") == job_id)
    return v.orderBy("job_id", "record_id", F.col("sub_key").asc_nulls_first())


__all__ = [
    "load", "documents_records", "attribute_scan", "job_units", "list_units_from_arrays",
    "list_units_from_rows", "unit_key", "parse_unit_key", "record_lookup", "tokens_table",
    "token_scan", "require_all_found", "change_scan", "changes_from_labels",
    "edited_documents", "vector_scan_ordered", "tokenize",
]
