"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole given
tables. Float outputs are rounded to 6 places (``r6``) so an SQL engine can
reproduce them bit for bit; vectors are reported in long form
``(…, position, value)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indexing import ordinal_within
from ..functions.text import split_parts
from ..functions.time import from_micros, micros
from ..functions.vectors import r6
from ..operators import count_embed, dispatch, metrics
from ..operators.hashed import hashed_embed
from ..operators.model_embed import model_embed
from ..operators import knn, pca, word_blocks
from ..sinks.vector_store import VectorStore
from . import encode
from . import jobs as plans
from ..streaming import gate
from ..streaming import jobs as sjobs
from ..streaming.throttle import throttle_by_key, throttle_stream
from ..session import fresh_path, release
from . import reduce as rplans
from ..schema import (BOC, BOW, DOCUMENT_IS_SPLITTED, EMBEDDING_LIST, MSG_FINISHED, MSG_INITIALIZING,
                      ERR_OPENAI_KEY, MSG_STARTED, NOTE_DONE, NOTE_FAILED, REDUCED_BOW, SPLIT_CHARS, TFIDF,
                      TOKEN_BATCH, TOKEN_MISMATCHING, TOKEN_WAIT_CHECKS, TOKEN_WAIT_SECONDS)
from ..sources import jobs as jsrc
from ..sources import records as src


def _doc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.job_units(src.documents_records(spark, sf_dir))


def _long_out(long_df: DataFrame) -> DataFrame:
    return long_df.select("job_id", "record_id", "position", r6(F.col("value")).alias("value"))


# --- 2.1 scans -------------------------------------------------------------

def q_attribute_scan(spark, sf_dir):
    return src.attribute_scan(src.documents_records(spark, sf_dir))


def q_list_attribute_units(spark, sf_dir):
    return src.list_units_from_rows(spark, sf_dir)


def q_tokenize(spark, sf_dir):
    return src.tokens_table(src.documents_records(spark, sf_dir))


# --- 2.6 count embedders ---------------------------------------------------

def q_boc_embed(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    return _long_out(count_embed.fit_transform(units, BOC)[1])


def q_bow_embed(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    return _long_out(count_embed.fit_transform(units, BOW)[1])


def q_tfidf_embed(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    return _long_out(count_embed.fit_transform(units, TFIDF)[1])


def q_split_long_text(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    return split_parts(units, ["job_id", "record_id"]).select(
        "job_id", "record_id", F.col("part_idx").cast("int").alias("part_idx"), "n_parts", "part_len", "part")


def q_hashed_embed(spark, sf_dir):
    return _long_out(hashed_embed(_doc_units(spark, sf_dir)))


def q_model_embed(spark, sf_dir):
    v = model_embed(_doc_units(spark, sf_dir))
    return v.select("job_id", "record_id", F.posexplode("vector").alias("position", "value")) \
            .select("job_id", "record_id", F.col("position").cast("int").alias("position"),
                    r6(F.col("value")).alias("value"))


def _token_units(spark, sf_dir, by_record=False):
    docs = src.documents_records(spark, sf_dir)
    if by_record:   # for windows over a record: its text is a fraction of its token rows, which then need no shuffle
        docs = docs.repartition("project_id", "record_id")
    toks = src.tokens_table(docs)
    return toks.select(F.col("project_id").alias("job_id"), "record_id",
                       F.col("token_idx").alias("sub_key"), F.col("token").alias("text"))


def q_token_boc_embed(spark, sf_dir):
    units = _token_units(spark, sf_dir)
    out = count_embed.fit(units, BOC).transform(units)
    return out.select("job_id", "record_id", F.col("sub_key").alias("token_idx"), "position",
                      r6(F.col("value")).alias("value"))


# --- 2.6 dispatch, 2.3 recommendations --------------------------------------

def q_job_resolve(spark, sf_dir):
    return dispatch.job_resolve(jsrc.jobs_table(spark, sf_dir), jsrc.project_counts(spark, sf_dir))


def q_model_recommend(spark, sf_dir):
    return dispatch.model_recommend(spark, jsrc.project_counts(spark, sf_dir))


# --- 2.5 counts and reports -------------------------------------------------

def q_unit_count(spark, sf_dir):
    docs = src.documents_records(spark, sf_dir)
    conv = src.load(spark, sf_dir, "conversations").select(F.lit(src.CONVERSATION_PROJECT).alias("project_id"))
    return metrics.unit_count(docs.select("project_id").unionByName(conv))


def q_unit_count_by_type(spark, sf_dir):
    docs = src.documents_records(spark, sf_dir).select("project_id")
    conv = src.load(spark, sf_dir, "conversations").select(
        F.lit(src.CONVERSATION_PROJECT).alias("project_id"), F.col("conv_id"))
    lists = conv.select("project_id").limit(1).select(
        "project_id", F.lit(src.LIST_ATTRIBUTE).alias("name"), F.lit(EMBEDDING_LIST).alias("data_type"))
    attributes = jsrc.attributes_table(spark, sf_dir).select("project_id", "name", "data_type").unionByName(lists)
    records = docs.unionByName(conv.distinct().select("project_id"))
    return metrics.unit_count_by_type(attributes, records, conv)


def q_vector_count(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    vectors = count_embed.fit(units, BOC).compact(units)
    return metrics.vector_count(vectors)


def q_progress_by_batch(spark, sf_dir):
    expected = metrics.unit_count(_doc_units(spark, sf_dir), "job_id")
    return metrics.progress_by_batch(expected)


def q_progress(spark, sf_dir):
    """Progress of jobs that have not yet stored the labelled documents; one that has stored less than half is INITIALIZING."""
    units = _doc_units(spark, sf_dir)
    expected = metrics.unit_count(units, "job_id")
    labelled = src.load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("record_id"))
    store = VectorStore(spark)
    store.append(model_embed(units.join(labelled, "record_id", "left_anti"), compact=True).withColumn("project_id", F.col("job_id")))
    stored = store.vectors()
    states = expected.join(metrics.vector_count(stored), "job_id", "left").select(
        "job_id", F.when(F.coalesce("n_vectors", F.lit(0)) * 2 < F.col("expected"), "INITIALIZING")
        .otherwise("ENCODING").alias("state"))
    return metrics.progress(states, stored, expected)


def q_tokenization_progress(spark, sf_dir):
    docs = src.documents_records(spark, sf_dir)
    return metrics.tokenization_progress(docs, src.tokens_table(docs))


def q_batch_plan(spark, sf_dir):
    return metrics.batch_plan(_doc_units(spark, sf_dir)).select("job_id", "record_id", "pos", "batch")


def _model_tokens(docs):
    """Tokens as a model's own tokenizer sees them: whitespace-separated pieces."""
    return docs.select("project_id", "record_id",
                       F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("token_idx", "token"))


def q_token_mismatch(spark, sf_dir):
    docs = src.documents_records(spark, sf_dir)
    return metrics.token_mismatch(src.tokens_table(docs), _model_tokens(docs))


def _warnings(spark, sf_dir):
    docs = src.documents_records(spark, sf_dir)
    ranked = ordinal_within(docs.select("project_id", "record_id", "text"), ["project_id"], ["record_id"], "pos")
    split = ranked.filter(F.length("text") > SPLIT_CHARS).select(
        "project_id", "record_id", F.lit(DOCUMENT_IS_SPLITTED).alias("warning_type"), "pos")
    mism = metrics.token_mismatch(src.tokens_table(docs), _model_tokens(docs)).select("project_id", "record_id")
    mism = ranked.join(mism, ["project_id", "record_id"], "left_semi").select(
        "project_id", "record_id", F.lit(TOKEN_MISMATCHING).alias("warning_type"), "pos")
    return docs, split.unionByName(mism)


def q_warning_report(spark, sf_dir):
    docs, warnings = _warnings(spark, sf_dir)
    data = docs.select("project_id", "record_id",
                       F.create_map(F.lit("doc_id"), F.col("record_id"), F.lit("lang"), F.col("lang")).alias("data"))
    return metrics.warning_report(warnings, data, jsrc.attributes_table(spark, sf_dir))


def q_job_latest_state(spark, sf_dir):
    return metrics.job_latest_state(jsrc.job_events(spark, sf_dir))


def q_failure_report(spark, sf_dir):
    return metrics.failure_report(jsrc.job_events(spark, sf_dir))


def q_cancel_cut(spark, sf_dir):
    return metrics.cancel_cut(jsrc.job_events(spark, sf_dir))


def _changes(spark, sf_dir):
    return src.change_scan(src.changes_from_labels(spark, sf_dir)).dropDuplicates(
        ["job_id", "record_id", "sub_key"])


def q_vector_count_check(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    edited = src.edited_documents(spark, sf_dir)
    units = edited.join(changes.select(F.col("job_id").alias("project_id"), "record_id"),
                        ["project_id", "record_id"], "left_semi")
    new = model_embed(src.job_units(units), compact=True).filter(F.col("error_class").isNull())
    return metrics.vector_count_check(changes, new)


# --- 2.2 event and notification rows ----------------------------------------

def q_job_event_append(spark, sf_dir):
    ev = jsrc.job_events(spark, sf_dir)
    state_msg = F.concat_ws(":", F.lit("events"), F.lit("embedding"), "job_id", F.lit("state"), "state")
    note_msg = F.concat_ws(":", F.lit("GLOBAL"), F.lit("notification_created"), "job_id")
    msgs = F.when(F.col("state") == "WAITING", F.array(state_msg)).otherwise(F.array(state_msg, note_msg))
    return ev.select("event_id", F.posexplode(msgs).alias("seq", "message")) \
             .withColumn("seq", F.col("seq").cast("int"))


def q_notification_append(spark, sf_dir):
    ev = jsrc.job_events(spark, sf_dir).filter(F.col("state") != "WAITING")
    model, attr = F.col("platform"), F.lit("text")
    fmt = lambda t: t.replace("{model}", "%2$s").replace("{attribute}", "%1$s")
    msg = (F.when(F.col("state") == "INITIALIZING", F.format_string(fmt(MSG_INITIALIZING), attr, model))
           .when(F.col("state") == "ENCODING", F.format_string(fmt(MSG_STARTED), attr, model))
           .when(F.col("state") == "FINISHED", F.format_string(fmt(MSG_FINISHED), attr, model))
           .otherwise(metrics.failure_message(F.col("platform"), F.col("error_class"),
                                              F.concat(F.lit("connection failed at event "),
                                                       F.col("event_id").cast("string")))))
    level = (F.when(F.col("state").isin("INITIALIZING", "ENCODING"), "INFO")
             .when(F.col("state") == "FINISHED", "SUCCESS").otherwise("ERROR"))
    ntype = (F.when(F.col("state").isin("INITIALIZING", "ENCODING"), "EMBEDDING_CREATION_STARTED")
             .when(F.col("state") == "FINISHED", "EMBEDDING_CREATION_DONE").otherwise("EMBEDDING_CREATION_FAILED"))
    return ev.select("event_id", "job_id", level.alias("level"), ntype.alias("type"), msg.alias("message"))


# --- 2.1 / 2.3 / 2.4 change handling ------------------------------------------

def q_change_scan(spark, sf_dir):
    return src.change_scan(src.changes_from_labels(spark, sf_dir))


def q_change_filter(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    # the same changes also arrive for jobs that do not exist (any more)
    changes = changes.unionByName(changes.withColumn("job_id", F.concat(F.lit("removed:"), "job_id")))
    jobs = src.documents_records(spark, sf_dir).select(F.col("project_id").alias("job_id")).distinct()
    return changes.join(jobs, "job_id", "left_semi")


def q_record_lookup(spark, sf_dir):
    ids = _changes(spark, sf_dir).select(F.col("job_id").alias("project_id"), "record_id")
    return src.record_lookup(src.edited_documents(spark, sf_dir), ids).select("project_id", "record_id", "text")


def q_order_preserving_lookup(spark, sf_dir):
    """Changed records with the position that their request gave them in its job."""
    changes = ordinal_within(_changes(spark, sf_dir), ["job_id"], ["record_id"], "position")
    recs = src.edited_documents(spark, sf_dir).withColumnRenamed("project_id", "job_id")
    missing = src.require_all_found(changes, recs, ["job_id", "record_id"])
    if missing.limit(1).count() > 0:
        raise KeyError("changed records not found")
    return changes.join(recs, ["job_id", "record_id"]).select("job_id", "record_id", "position", "text")


def q_list_entry_project(spark, sf_dir):
    """Changed list entries (assistant turns) resolved to the text at their sub_key; no list is copied."""
    conv = src.load(spark, sf_dir, "conversations").select(
        F.lit(src.CONVERSATION_PROJECT).alias("project_id"),
        F.col("conv_id").cast("string").alias("record_id"), "turn", "role")
    pos = ordinal_within(conv, ["project_id", "record_id"], ["turn"], "sub_key")
    changed = pos.filter(F.col("role") == "assistant").select("record_id", F.col("sub_key").cast("int"))
    entries = src.list_units_from_rows(spark, sf_dir).select("record_id", "sub_key", "text")
    return changed.join(entries, ["record_id", "sub_key"])


def q_token_scan(spark, sf_dir):
    docs = src.documents_records(spark, sf_dir)
    ids = _changes(spark, sf_dir).select(F.col("job_id").alias("project_id"), "record_id")
    tokens = src.tokens_table(docs, "text").unionByName(src.tokens_table(docs, "lang"))
    return src.token_scan(tokens, "text", ids).select("project_id", "record_id", "token_idx", "token")


# --- 2.2 sinks, read back ---------------------------------------------------------

def _boc_doc_vectors(spark, sf_dir):
    docs = src.documents_records(spark, sf_dir)
    units = src.job_units(docs)
    model = count_embed.fit(units, BOC)
    return model, model.compact(units).withColumn("project_id", F.col("job_id"))


def _vsum(df):
    return F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x).cast("long")


def _width():
    """Width of a stored vector."""
    return F.coalesce("width", F.size("vector"))


def _read_back(store, with_sub=False):
    v = store.rows()   # the zeros left out add nothing
    cols = ["job_id", "record_id"] + (["sub_key"] if with_sub else [])
    return v.select(*cols, _vsum(v).alias("vsum"))


def q_vector_append(spark, sf_dir):
    _, vecs = _boc_doc_vectors(spark, sf_dir)
    store = VectorStore(spark)
    store.append(vecs)
    v = store.rows()
    return v.select("job_id", "record_id", _width().cast("long").alias("n_dims"), _vsum(v).alias("vsum"))


def q_vector_replace_job(spark, sf_dir):
    model, vecs = _boc_doc_vectors(spark, sf_dir)
    store = VectorStore(spark)
    store.append(vecs)
    edited = src.job_units(src.edited_documents(spark, sf_dir))
    store.replace_jobs(model.compact(edited).withColumn("project_id", F.col("job_id")))
    return _read_back(store)


def q_vector_delete_records(spark, sf_dir):
    _, vecs = _boc_doc_vectors(spark, sf_dir)
    store = VectorStore(spark)
    store.append(vecs)
    store.delete_records(_changes(spark, sf_dir).select("job_id", "record_id"))
    return _read_back(store)


def _conversation_units(spark, sf_dir):
    u = src.list_units_from_rows(spark, sf_dir)
    return u.select(F.col("project_id").alias("job_id"), "record_id", "sub_key", "text")


def q_vector_delete_subkeys(spark, sf_dir):
    units = _conversation_units(spark, sf_dir)
    model = count_embed.fit(units, BOC)
    store = VectorStore(spark)
    store.append(model.compact(units).withColumn("project_id", F.col("job_id")))
    conv = src.load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("record_id"), "turn", "role")
    ranked = ordinal_within(conv.withColumn("job_id", F.lit(src.CONVERSATION_PROJECT)),
                            ["job_id", "record_id"], ["turn"], "sub_key")
    keys = ranked.filter(F.col("role") == "assistant").select("job_id", "record_id", F.col("sub_key").cast("int"))
    store.delete_subkeys(keys)
    return _read_back(store, with_sub=True)


def _upserted(spark, sf_dir):
    """A store after an upsert, and a scan of it that was planned before."""
    model, vecs = _boc_doc_vectors(spark, sf_dir)
    store = VectorStore(spark)
    store.append(vecs)
    changes = _changes(spark, sf_dir)
    edited = src.job_units(src.edited_documents(spark, sf_dir)).join(
        changes.select("job_id", "record_id"), ["job_id", "record_id"], "left_semi")
    # the new text has other counts than the old one, so that an upsert that does nothing shows
    edited = edited.withColumn("text", F.concat("text", F.lit("eee")))
    before = store.rows()
    store.upsert(model.compact(edited).withColumn("project_id", F.col("job_id")))
    return store, before


def q_vector_upsert(spark, sf_dir):
    store, _ = _upserted(spark, sf_dir)
    return _read_back(store)


def q_vector_snapshot(spark, sf_dir):
    """What a scan planned before an upsert reads after it, beside the new state of an opened-again store."""
    store, before = _upserted(spark, sf_dir)
    store.vacuum(keep=2)
    old = before.select("job_id", "record_id", _vsum(before).alias("vsum_before"))
    return old.join(_read_back(VectorStore(spark, store.root)), ["job_id", "record_id"], "full") \
        .withColumnRenamed("vsum", "vsum_after")


def q_vector_export(spark, sf_dir):
    _, vecs = _boc_doc_vectors(spark, sf_dir)
    store = VectorStore(spark)
    store.append(vecs)
    store.export()
    e = store.read_export()
    return e.select("job_id", "record_id", _vsum(e).alias("vsum"))


def q_export_policy(spark, sf_dir):
    _, vecs = _boc_doc_vectors(spark, sf_dir)
    store = VectorStore(spark)
    store.append(vecs)
    store.export()
    store.delete_records(_changes(spark, sf_dir).select("job_id", "record_id"))
    store.export(force=False)        # an existing export is kept
    return store.read_export().groupBy("job_id").agg(F.count(F.lit(1)).alias("n_rows"))


def q_search_collection_build(spark, sf_dir):
    _, vecs = _boc_doc_vectors(spark, sf_dir)
    store = VectorStore(spark)
    store.append(vecs)
    store.build_collection(lsh_buckets=4)
    c = store.collection()
    s = F.aggregate("unit", F.lit(0.0), lambda a, x: a + x)
    return c.select("job_id", "record_id", r6(s).alias("unit_sum"))


def _store_docs_and_conversations(spark, sf_dir):
    _, vecs = _boc_doc_vectors(spark, sf_dir)
    units = _conversation_units(spark, sf_dir)
    cm = count_embed.fit(units, BOC)
    store = VectorStore(spark)
    store.append(vecs)
    store.append(cm.compact(units).withColumn("project_id", F.col("job_id")))
    store.export()
    store.build_collection()
    return store


def q_search_collection_drop(spark, sf_dir):
    store = _store_docs_and_conversations(spark, sf_dir)
    store.drop_collection(src.CONVERSATION_PROJECT)
    return store.collection().groupBy("job_id").agg(F.count(F.lit(1)).alias("n_rows"))


def q_job_delete(spark, sf_dir):
    store = _store_docs_and_conversations(spark, sf_dir)
    store.delete_job(src.CONVERSATION_PROJECT)
    n = lambda df, kind: df.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("kind", F.lit(kind))
    return n(store.vectors(), "vectors").unionByName(n(store.read_export(), "exports")) \
        .unionByName(n(store.collection(), "collection")).select("kind", "job_id", "n_rows")


# --- 2.6 model lifecycle and composed jobs --------------------------------------------

def q_model_save_load(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    store = VectorStore(spark)
    plans.encode_job(store, units, TFIDF, build_collection=False)
    reloaded = plans.load_model(store, TFIDF)
    return _long_out(reloaded.transform(units))


def q_transform(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    model = count_embed.fit(units, BOW)
    edited = src.job_units(src.edited_documents(spark, sf_dir))
    return _long_out(model.transform(edited))


def q_score_texts(spark, sf_dir):
    docs = src.documents_records(spark, sf_dir)
    units = docs.select(F.lit("corpus").alias("job_id"), "record_id", F.lit(None).cast("int").alias("sub_key"),
                        "text")
    model = count_embed.fit(units, TFIDF)
    out = plans.score_texts(model, src.load(spark, sf_dir, "benchmark"), "corpus")
    return out.select("record_id", "position", r6(F.col("value")).alias("value"))


def q_fit_transform(spark, sf_dir):
    units = _conversation_units(spark, sf_dir)
    model, out = count_embed.fit_transform(units, BOW)
    return out.select("job_id", "record_id", "sub_key", "position", r6(F.col("value")).alias("value"))


def q_encode_job(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    store = VectorStore(spark)
    plans.encode_job(store, units, BOC)
    cnt = lambda df, name: df.groupBy("job_id").agg(F.count(F.lit(1)).alias(name))
    return (cnt(store.vectors(), "n_vectors").join(cnt(store.read_export(), "n_exported"), "job_id")
            .join(cnt(store.collection(), "n_indexed"), "job_id").join(plans.job_states(store), "job_id"))


def q_re_embed(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    store = VectorStore(spark)
    plans.encode_job(store, units, BOW, build_collection=False)
    edited = src.edited_documents(spark, sf_dir)
    current = src.documents_records(spark, sf_dir).join(edited.select("project_id", "record_id"),
                                                         ["project_id", "record_id"], "left_anti") \
        .select("project_id", "record_id", "text").unionByName(edited.select("project_id", "record_id", "text"))
    plans.re_embed(store, src.changes_from_labels(spark, sf_dir), current, BOW)
    return _read_back(store)


# Attribute and token jobs over all documents, one of each way of saving an embedder.
SAVED_EMBEDDERS = [("characters", "ON_ATTRIBUTE", "python", BOC), ("tf-idf", "ON_ATTRIBUTE", "python", TFIDF),
                   ("reduced-words", "ON_ATTRIBUTE", "python", BOW), ("reduced-model", "ON_ATTRIBUTE", "huggingface", "built-in"),
                   ("tokens", "ON_TOKEN", "python", BOC)]


def _twins(spark, sf_dir):
    """(record_id, text, is_new): the documents, where the n-th labelled one now has the text of the n-th other one."""
    docs = src.documents_records(spark, sf_dir).select("record_id", "text")
    labelled = src.edited_documents(spark, sf_dir).select("record_id", F.lit(1).alias("is_new"))
    docs = docs.join(labelled, "record_id", "left").fillna(0, ["is_new"])
    ranked = ordinal_within(docs, ["is_new"], ["record_id"], "n")
    others = ranked.filter("is_new = 0").select(F.col("n").alias("m"), F.col("record_id").alias("twin"), F.col("text").alias("new_text"))
    total = others.count()
    edited = ranked.filter("is_new = 1").select("record_id", "is_new", (F.col("n") % max(total, 1)).alias("m")).join(others, "m")
    return docs.filter("is_new = 0").select("record_id", "text", "is_new", F.col("record_id").alias("twin")).unionByName(
        edited.select("record_id", F.col("new_text").alias("text"), "is_new", "twin"))


def _alike(a, b):
    """Whether two stored vectors agree up to rounding."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x - y) > 1e-4 * (1 + F.abs(x)))
    return (F.size(a) == F.size(b)) & ~F.exists(apart, lambda x: F.coalesce(x, F.lit(True)))


def q_re_embed_saved(spark, sf_dir):
    """One change set over five kinds of jobs, each with its saved embedder: a changed record takes the text of another,
    so its vectors must become that record's; the others keep theirs."""
    docs = src.documents_records(spark, sf_dir).select(F.lit("corpus").alias("project_id"), "record_id", "text")
    tokens = lambda d: src.tokens_table(d).select("project_id", "record_id", F.col("token_idx").alias("sub_key"),
                                                  F.col("token").alias("text"))
    jobs = spark.createDataFrame([(j, "corpus", "text", t, p, m) for j, t, p, m in SAVED_EMBEDDERS],
                                 "job_id string, project_id string, attribute_id string, type string, platform string, model string")
    store = VectorStore(spark)
    counts = docs.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_records"))
    encode.encode_jobs(store, jobs, counts, docs.withColumn("sub_key", F.lit(None).cast("int")), tokens(docs),
                       export=False, build_collection=False)
    before = store.rows()             # the state before goes on being readable
    path = fresh_path(spark, "twins")
    _twins(spark, sf_dir).write.parquet(path)
    twins = spark.read.parquet(path)
    entry = F.array(F.struct("record_id", F.lit(src.TEXT_ATTRIBUTE).alias("attribute_name")))
    changes = twins.filter("is_new = 1").select(F.explode(F.array(*[F.lit(j[0]) for j in SAVED_EMBEDDERS])).alias("j"), "record_id") \
        .select(F.to_json(F.create_map("j", entry)).alias("value"))
    current = twins.select(F.lit("corpus").alias("project_id"), "record_id", "text")
    plans.re_embed(store, changes, current, tokens=tokens(current), export=False)
    after = store.rows().join(twins.select("record_id", "is_new", "twin"), "record_id")
    old = before.select(F.col("job_id").alias("j"), F.col("record_id").alias("r"), F.col("sub_key").alias("s"), F.col("vector").alias("was"),
                        F.col("positions").alias("at"))
    same = (F.col("job_id") == F.col("j")) & (F.col("twin") == F.col("r")) & F.col("sub_key").eqNullSafe(F.col("s"))
    placed = F.col("positions").eqNullSafe(F.col("at"))
    equal = placed & _alike("vector", "was")
    return after.join(old, same, "left").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_vectors"), F.sum("is_new").cast("long").alias("n_changed"),
        F.count(F.when((F.col("is_new") == 1) & equal, 1)).alias("n_like_twin"),
        F.count(F.when((F.col("is_new") == 0) & placed & (F.col("vector") == F.col("was")), 1)).alias("n_kept"),
        F.max(_width()).cast("long").alias("width"))


def q_score_saved(spark, sf_dir):
    """Benchmark texts scored with the embedder that the registry names for the job."""
    units = _corpus_units(spark, sf_dir)
    store = VectorStore(spark)
    plans.encode_job(store, units, TFIDF, build_collection=False, export=False)
    out = plans.score_with_job(store, src.load(spark, sf_dir, "benchmark"), "corpus")
    return out.select("record_id", "position", r6(F.col("value")).alias("value"))


ENCODE_COMMITS, CANCELLED_BEFORE = 4, 2


def q_encode_cancelled(spark, sf_dir):
    """Token jobs written in four commits; every second project is cancelled before the third and keeps its earlier batches."""
    jobs = jsrc.jobs_table(spark, sf_dir).filter("type = 'ON_TOKEN' AND platform = 'python'").filter(F.col("model") == BOC)
    names = src.documents_records(spark, sf_dir).select("project_id").distinct()
    chosen = ordinal_within(names.withColumn("all", F.lit(0)), ["all"], ["project_id"], "n").filter("n % 2 = 1")
    cancel = jobs.join(chosen.select("project_id"), "project_id", "left_semi")
    units = _doc_units(spark, sf_dir).withColumnRenamed("job_id", "project_id")
    tokens = _token_units(spark, sf_dir).withColumnRenamed("job_id", "project_id")
    store = VectorStore(spark)

    def user(number):
        if number == CANCELLED_BEFORE:
            plans.append_events(store, plans.state_rows(cancel, "FAILED"))
    states = encode.encode_jobs(store, jobs, jsrc.project_counts(spark, sf_dir), units, tokens, export=False, build_collection=False,
                                commits=ENCODE_COMMITS, before_commit=user)
    kept = store.rows().groupBy("job_id").agg(F.count(F.lit(1)).alias("n_vectors"), F.sum(_vsum(None)).alias("n_chars"))
    return kept.join(states, "job_id").join(plans.job_states(store).withColumnRenamed("state", "last_state"), "job_id")


# --- PCA, sketches, k-NN ----------------------------------------------------------------

def _embeddings(spark, sf_dir):
    return src.load(spark, sf_dir, "embeddings").select(
        F.lit("embeddings").alias("job_id"), F.col("vec_id").cast("string").alias("record_id"),
        F.lit(None).cast("int").alias("sub_key"), F.col("embedding").cast("array<double>").alias("vector"))


def q_pca_fit(spark, sf_dir):
    fitted = pca.narrow_fit(_embeddings(spark, sf_dir), 64)["embeddings"]
    cov = fitted["cov"]
    d = cov.shape[0]
    rows = [(i, j, float(round(cov[i, j], 6)) + 0.0) for i in range(d) for j in range(i, d)]
    return spark.createDataFrame(rows, "i int, j int, cov double")


def q_pca_transform(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    fitted = pca.narrow_fit(emb, 64)
    out = pca.narrow_transform(emb, fitted, ["job_id", "record_id", "sub_key"])
    sq = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("record_id", F.round(sq, 4).alias("sq_norm"))


def q_seeded_projection(spark, sf_dir):
    y = rplans.seeded_projection(_doc_units(spark, sf_dir))
    return y.select("job_id", "record_id", F.posexplode("y").alias("j", "value")).select(
        "job_id", "record_id", F.col("j").cast("int").alias("j"), r6(F.col("value")).alias("value"))


def q_bow_pca_embed(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    counts = jsrc.project_counts(spark, sf_dir).select(F.col("project_id").alias("job_id"), "n_records")
    return _long_out(rplans.bow_pca_embed(units, counts))


def _corpus_units(spark, sf_dir):
    """All documents as one job."""
    return src.documents_records(spark, sf_dir).select(
        F.lit("corpus").alias("job_id"), "record_id", F.lit(None).cast("int").alias("sub_key"), "text")


def q_bow_pca_invariants(spark, sf_dir):
    """PCA of one job over all documents: units kept, centred, uncorrelated, within the total variance."""
    units = _corpus_units(spark, sf_dir)
    blocks = count_embed.blocks_of(units, BOW)   # counted once for the fit and the total
    model, coords = rplans.fit_reduced(units, blocks=blocks)
    m = pca.moments(coords.select("job_id", "vector"), "vector")
    size = F.when(F.col("i") == F.col("j"), F.col("v"))
    got = m.groupBy("job_id").agg(
        F.max(F.when(F.col("i") == -2, F.col("v"))).cast("long").alias("n_units"),
        F.count(F.when(F.col("i") == -1, F.lit(1))).alias("n_components"),
        F.max(F.when(F.col("i") == -1, F.abs("v"))).alias("sum"),
        F.max(F.when((F.col("i") >= 0) & (F.col("i") < F.col("j")), F.abs("v"))).alias("off"),
        F.max(F.when(F.col("i") >= 0, size)).alias("largest"), F.sum(F.when(F.col("i") >= 0, size)).alias("captured"))
    path = fresh_path(spark, "term-sums")
    for part in word_blocks.parts(blocks):
        model.counts.transform_blocks(part).groupBy("job_id", "position").agg(
            F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).write.mode("append").parquet(path)
        release(spark)
    per_term = spark.read.parquet(path).groupBy("job_id", "position").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = per_term.join(model.counts.stats().select("job_id", "n_units"), "job_id").groupBy("job_id").agg(
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n_units")).alias("total"))
    return got.join(total, "job_id").select(
        "job_id", "n_units", "n_components", r6(F.col("sum") / F.col("n_units")).alias("worst_mean"),
        r6(F.col("off") / F.col("largest")).alias("worst_correlation"), F.round("total", 2).alias("total"),
        ((F.col("captured") > 0) & (F.col("captured") <= F.col("total") * (1 + 1e-9))).alias("captured_within_total"))


def q_reduced_model_save_load(spark, sf_dir):
    """A reduced model saved beside a store, loaded again and applied: every unit has all components."""
    units = _corpus_units(spark, sf_dir)
    store = VectorStore(spark)
    plans.save_model(store, REDUCED_BOW, rplans.fit_reduced(units)[0])
    out = plans.load_model(store, REDUCED_BOW).dense(units)
    return out.select("record_id", F.size("vector").alias("n_components"))


def q_model_pca_embed(spark, sf_dir):
    """Document-level model vectors of one job over all documents, reduced to 64."""
    units = _corpus_units(spark, sf_dir)
    counts = units.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_records"))
    out = rplans.model_pca_embed(units, counts)
    return out.select("record_id", F.posexplode("vector").alias("position", "value")).select(
        "record_id", "position", r6(F.col("value")).alias("value"))


def q_token_model_vectors(spark, sf_dir):
    """Token vectors before their reduction (entries that are not 0)."""
    vectors, _ = rplans.model_vectors(rplans.token_contexts(_token_units(spark, sf_dir, by_record=True)), batch_size=TOKEN_BATCH)
    at = F.coalesce("positions", F.transform("vector", lambda _, i: i))
    return vectors.select("job_id", "record_id", F.col("sub_key").alias("token_idx"),
                          F.inline(F.arrays_zip(at.alias("position"), F.col("vector").alias("value")))).where("value <> 0").select(
        "job_id", "record_id", "token_idx", "position", r6(F.col("value")).alias("value"))


# Kinds of jobs that the registered encode run asks for in every project.
ENCODE_REQUESTS = [("ON_ATTRIBUTE", "python", BOC), ("ON_ATTRIBUTE", "openai", "text-embedding-3-small"),
                   ("ON_ATTRIBUTE", "azure", "text-embedding-3-small"), ("ON_ATTRIBUTE", "python", "word2vec"),
                   ("ON_ATTRIBUTE", "unknown-platform", "some-model"), ("ON_TOKEN", "python", BOC),
                   ("ON_TOKEN", "python", TFIDF)]


def _no_access():
    """Factory of a model function whose provider refuses the key."""
    def fn(texts):
        raise RuntimeError(ERR_OPENAI_KEY)
    return fn


def q_encode_jobs(spark, sf_dir):
    """Attribute and token jobs of every project through the dispatch; Azure refuses the key, some requests are invalid."""
    jobs = jsrc.jobs_table(spark, sf_dir)
    asked = F.lit(False)
    for t, p, m in ENCODE_REQUESTS:
        asked = asked | ((F.col("type") == t) & (F.col("platform") == p) & (F.col("model") == m))
    units = _doc_units(spark, sf_dir).withColumnRenamed("job_id", "project_id")
    tokens = _token_units(spark, sf_dir).withColumnRenamed("job_id", "project_id")
    store = VectorStore(spark)
    encode.encode_jobs(store, jobs.filter(asked), jsrc.project_counts(spark, sf_dir), units, tokens,
                       lambda platform, model: _no_access if platform == "azure" else None,
                       export=False, build_collection=False)
    last = encode.notifications(store).filter(F.col("type").isin("EMBEDDING_CREATION_DONE", "EMBEDDING_CREATION_FAILED"))
    return (plans.job_states(store).join(metrics.vector_count(store.vectors()), "job_id", "left").fillna(0, ["n_vectors"])
            .join(last.select("job_id", "level", "message"), "job_id"))


def q_token_model_embed(spark, sf_dir):
    out = rplans.token_model_embed(_token_units(spark, sf_dir, by_record=True))
    return out.select("job_id", "record_id", F.col("sub_key").alias("token_idx"),
                      F.posexplode("vector").alias("position", "value")) \
        .select("job_id", "record_id", "token_idx", "position", r6(F.col("value")).alias("value"))


def q_knn_topk(spark, sf_dir):
    emb = src.load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"),
                                                        F.col("embedding").alias("vector"))
    return knn.knn_topk(emb, emb, k=10, exclude_self=True).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", (F.col("score") + 0.0).alias("score"))


# --- explicit registrations of joined / ordered scans ---------------------------------

def q_vector_scan_ordered(spark, sf_dir):
    _, vecs = _boc_doc_vectors(spark, sf_dir)
    store = VectorStore(spark)
    store.append(vecs)
    v = src.vector_scan_ordered(store.rows()).withColumn("_turn", F.monotonically_increasing_id())
    # the place of each vector in the scan of its job, so that the order is part of the result
    v = ordinal_within(v, ["job_id"], ["_turn"], "place")
    return v.select("job_id", "record_id", "place", _vsum(v).alias("vsum"))


def q_changes_x_records(spark, sf_dir):
    """Changed records joined to their current contents."""
    changes = _changes(spark, sf_dir).select("job_id", "record_id")
    recs = src.edited_documents(spark, sf_dir)
    return changes.join(recs.select(F.col("project_id").alias("job_id"), "record_id", "text"),
                        ["job_id", "record_id"])


def q_warnings_x_records(spark, sf_dir):
    """Last warned record per (project, type) joined to its primary-key field values."""
    docs, warnings = _warnings(spark, sf_dir)
    last = warnings.groupBy("project_id", "warning_type").agg(
        F.max_by("record_id", F.struct("pos", "record_id")).alias("record_id"))
    pk = jsrc.attributes_table(spark, sf_dir).filter(F.col("is_primary_key")).groupBy("project_id").agg(
        F.array_sort(F.collect_list("name")).alias("pk_names"))
    data = docs.select("project_id", "record_id",
                       F.create_map(F.lit("doc_id"), F.col("record_id"), F.lit("lang"), F.col("lang")).alias("data"))
    j = last.join(pk, "project_id", "left").join(data, ["project_id", "record_id"], "left")
    return j.select("project_id", "warning_type", F.col("record_id").alias("example_record_id"),
                    F.array_join(F.transform("pk_names", lambda n: F.element_at(F.col("data"), n)), ", ")
                    .alias("pk_values"))


# --- 2.8 streams ---------------------------------------------------------------------

def _table_stream(spark, sf_dir, name):
    """A file stream over one table of the folder (new files matching it are new data)."""
    schema = src.load(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf_dir.rstrip("/")))


def _events_stream(spark, sf_dir):
    return _table_stream(spark, sf_dir, "events")


def q_throttle_by_key(spark, sf_dir):
    ev = src.load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return throttle_by_key(ev, "user_id", "ts", "event_id", 3600)


def q_throttle_stream(spark, sf_dir):
    out = fresh_path(spark, "throttle-out")
    s = throttle_stream(_events_stream(spark, sf_dir).select("event_id", "user_id", "ts"),
                        "user_id", "ts", "event_id", 3600)
    sjobs.run_available(s.writeStream.format("parquet").option("path", out).outputMode("append"),
                        fresh_path(spark, "ckpt-throttle"))
    return spark.read.parquet(out).select("event_id", "user_id", "ts")


def q_job_state_stream(spark, sf_dir):
    out = fresh_path(spark, "job-state")
    sjobs.job_state_stream(spark, jsrc.job_events_from(_events_stream(spark, sf_dir)), out)
    return sjobs.current_job_states(spark, out)


def q_token_gate_timeout(spark, sf_dir):
    return sjobs.token_gate(jsrc.job_events(spark, sf_dir))


def q_token_gate_stream(spark, sf_dir):
    """The gate as a stream with event-time timers: two halves of the events, then the end of time, each run resumed."""
    events = jsrc.job_events(spark, sf_dir).select("job_id", "ts", "state")
    middle, end = events.agg(F.percentile_approx(micros("ts"), 0.5), F.max(micros("ts"))).first()
    incoming, out, checkpoint = (fresh_path(spark, t) for t in ("gate-events", "gate-out", "ckpt-gate"))
    runs = [events.where(micros("ts") <= middle), events.where(micros("ts") > middle)]
    if end is not None:  # a row of no job, a day later, moves the watermark past every timer
        runs.append(spark.range(1).select(F.lit(None).cast("string").alias("job_id"),
                                          from_micros(F.lit(end + 86_400_000_000)).alias("ts"), F.lit("NONE").alias("state")))
    for rows in runs:
        rows.write.mode("append").parquet(incoming)
        decided = gate.token_gate_stream(spark.readStream.schema(events.schema).parquet(incoming), clock="event")
        sjobs.run_available(decided.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    return gate.decisions(spark, out)


def _tokenization_events(spark, sf_dir, jobs):
    """Events of token jobs behind one tokenizer: a project with the mean of characters is ready at the last check."""
    sizes = src.documents_records(spark, sf_dir).groupBy("project_id").agg(F.sum(F.length("text")).alias("chars"))
    total, n = sizes.agg(F.sum("chars"), F.count(F.lit(1))).first()
    seconds = F.expr(f"{TOKEN_WAIT_CHECKS * TOKEN_WAIT_SECONDS * n} * chars div {max(1, total or 0)}")
    start = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    waits = jobs.join(sizes, "project_id").select(
        "job_id", F.explode(F.array(F.struct(F.lit("WAITING").alias("state"), F.lit(0).cast("long").alias("s")),
                                    F.struct(F.lit("ENCODING").alias("state"), seconds.alias("s")))).alias("e"))
    return waits.select("job_id", F.timestamp_add("SECOND", F.col("e.s").cast("int"), start).alias("ts"), "e.state")


def q_encode_jobs_gated(spark, sf_dir):
    """Token jobs that wait for tokenisation: encoded where it is ready in time, else failed with a message."""
    jobs = jsrc.jobs_table(spark, sf_dir).filter("type = 'ON_TOKEN' AND platform = 'python'").filter(F.col("model") == BOC)
    units = _doc_units(spark, sf_dir).withColumnRenamed("job_id", "project_id")
    tokens = _token_units(spark, sf_dir).withColumnRenamed("job_id", "project_id")
    store = VectorStore(spark)
    encode.encode_jobs(store, jobs, jsrc.project_counts(spark, sf_dir), units, tokens, export=False, build_collection=False,
                       gate=sjobs.token_gate(_tokenization_events(spark, sf_dir, jobs)))
    states = spark.read.parquet(f"{store.root}/job_events").groupBy("job_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "seq", "state"))), ", ").alias("states"))
    last = encode.notifications(store).filter(F.col("type").isin(NOTE_DONE, NOTE_FAILED))
    return (states.join(metrics.vector_count(store.vectors()), "job_id", "left").fillna(0, ["n_vectors"])
            .join(last.select("job_id", "message"), "job_id"))


def q_re_embed_stream(spark, sf_dir):
    units = _doc_units(spark, sf_dir)
    store = VectorStore(spark)
    plans.encode_job(store, units, BOW, build_collection=False)
    change_dir = fresh_path(spark, "incoming-changes")
    src.changes_from_labels(spark, sf_dir).write.text(change_dir)
    edited = src.edited_documents(spark, sf_dir)
    current = src.documents_records(spark, sf_dir).join(edited.select("project_id", "record_id"),
                                                         ["project_id", "record_id"], "left_anti") \
        .select("project_id", "record_id", "text").unionByName(edited.select("project_id", "record_id", "text"))
    sjobs.re_embed_stream(spark, store, change_dir, current, BOW)
    return _read_back(store)


def q_re_embed_stream_lists(spark, sf_dir):
    """List entries (assistant turns, now reversed) arriving as changes in two runs; then the first batch comes again with
    other contents, and nothing may change."""
    units = _conversation_units(spark, sf_dir)
    store = VectorStore(spark)
    plans.encode_job(store, units, BOW, build_collection=False, export=False)
    changed = q_list_entry_project(spark, sf_dir).select("record_id", "sub_key", F.lit(True).alias("is_new"))
    entries = units.select(F.col("job_id").alias("project_id"), "record_id", "sub_key", "text")
    current = entries.join(changed, ["record_id", "sub_key"], "left").withColumn(
        "text", F.when(F.col("is_new"), F.reverse("text")).otherwise(F.col("text"))).drop("is_new")
    entry = F.array(F.struct("record_id", F.lit(src.TEXT_ATTRIBUTE).alias("attribute_name"),
                             F.col("sub_key").cast("string").alias("sub_key")))
    change_dir, checkpoint = fresh_path(spark, "incoming-changes"), fresh_path(spark, "ckpt-lists")
    whole = _doc_units(spark, sf_dir).select(F.col("job_id").alias("project_id"), "record_id", "text")
    for late in (False, True):
        arriving = changed.filter((F.col("sub_key") >= 2) == late)
        arriving.select(F.to_json(F.create_map(F.lit(src.CONVERSATION_PROJECT), entry)).alias("value")) \
            .write.mode("append").text(change_dir)
        sjobs.re_embed_stream(spark, store, change_dir, whole, checkpoint=checkpoint, list_records=current, export=False)
    again = sjobs.re_embed_batch(spark, store, checkpoint, whole, list_records=entries, export=False)
    again(spark.read.text(change_dir), 0)
    checked = sjobs.re_embed_checks(store).groupBy("job_id").agg(F.sum("n_changes").alias("n_changes"))
    return _read_back(store, with_sub=True).join(checked, "job_id")


def q_score_stream(spark, sf_dir):
    docs = src.documents_records(spark, sf_dir)
    units = docs.select(F.lit("corpus").alias("job_id"), "record_id", F.lit(None).cast("int").alias("sub_key"),
                        "text")
    model = count_embed.fit(units, TFIDF)
    stream = _table_stream(spark, sf_dir, "benchmark")
    out = fresh_path(spark, "scores")
    sjobs.score_stream(spark, model, stream, "corpus", out)
    return spark.read.parquet(out).select("record_id", "position", r6(F.col("value")).alias("value"))


QUERIES = {
    "attribute_scan": q_attribute_scan,
    "list_attribute_units": q_list_attribute_units,
    "tokenize": q_tokenize,
    "boc_embed": q_boc_embed,
    "bow_embed": q_bow_embed,
    "tfidf_embed": q_tfidf_embed,
    "split_long_text": q_split_long_text,
    "hashed_embed": q_hashed_embed,
    "model_embed": q_model_embed,
    "token_boc_embed": q_token_boc_embed,
    "job_resolve": q_job_resolve,
    "model_recommend": q_model_recommend,
    "unit_count": q_unit_count,
    "unit_count_by_type": q_unit_count_by_type,
    "vector_count": q_vector_count,
    "progress": q_progress,
    "progress_by_batch": q_progress_by_batch,
    "tokenization_progress": q_tokenization_progress,
    "batch_plan": q_batch_plan,
    "token_mismatch": q_token_mismatch,
    "warning_report": q_warning_report,
    "job_latest_state": q_job_latest_state,
    "failure_report": q_failure_report,
    "cancel_cut": q_cancel_cut,
    "vector_count_check": q_vector_count_check,
    "job_event_append": q_job_event_append,
    "notification_append": q_notification_append,
    "change_scan": q_change_scan,
    "change_filter": q_change_filter,
    "record_lookup": q_record_lookup,
    "order_preserving_lookup": q_order_preserving_lookup,
    "list_entry_project": q_list_entry_project,
    "token_scan": q_token_scan,
    "vector_append": q_vector_append,
    "vector_replace_job": q_vector_replace_job,
    "vector_delete_records": q_vector_delete_records,
    "vector_delete_subkeys": q_vector_delete_subkeys,
    "vector_upsert": q_vector_upsert,
    "vector_snapshot": q_vector_snapshot,
    "vector_export": q_vector_export,
    "export_policy": q_export_policy,
    "search_collection_build": q_search_collection_build,
    "search_collection_drop": q_search_collection_drop,
    "job_delete": q_job_delete,
    "model_save_load": q_model_save_load,
    "transform": q_transform,
    "score_texts": q_score_texts,
    "fit_transform": q_fit_transform,
    "encode_job": q_encode_job,
    "re_embed": q_re_embed,
    "re_embed_saved": q_re_embed_saved,
    "score_saved": q_score_saved,
    "encode_cancelled": q_encode_cancelled,
    "pca_fit": q_pca_fit,
    "pca_transform": q_pca_transform,
    "seeded_projection": q_seeded_projection,
    "bow_pca_embed": q_bow_pca_embed,
    "token_model_embed": q_token_model_embed,
    "bow_pca_invariants": q_bow_pca_invariants,
    "reduced_model_save_load": q_reduced_model_save_load,
    "model_pca_embed": q_model_pca_embed,
    "token_model_vectors": q_token_model_vectors,
    "encode_jobs": q_encode_jobs,
    "knn_topk": q_knn_topk,
    "vector_scan_ordered": q_vector_scan_ordered,
    "changes_x_records": q_changes_x_records,
    "warnings_x_records": q_warnings_x_records,
    "throttle_by_key": q_throttle_by_key,
    "throttle_stream": q_throttle_stream,
    "job_state_stream": q_job_state_stream,
    "token_gate_timeout": q_token_gate_timeout,
    "token_gate_stream": q_token_gate_stream,
    "encode_jobs_gated": q_encode_jobs_gated,
    "re_embed_stream": q_re_embed_stream,
    "re_embed_stream_lists": q_re_embed_stream_lists,
    "score_stream": q_score_stream,
}
