"""DuckDB SQL equivalents of the registered queries (same column names).

Views available: region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations.
"""

from __future__ import annotations

# Common table expressions shared by several oracles.
DOC_UNITS = """units AS (
  SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, text FROM documents)"""

WORD_TF = DOC_UNITS + """,
occ AS (SELECT job_id, record_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM units),
tf AS (SELECT job_id, record_id, term, count(*) AS n FROM occ GROUP BY job_id, record_id, term)"""

CHAR_TF = DOC_UNITS + """,
occ AS (SELECT job_id, record_id, unnest(regexp_extract_all(lower(text), '(?s).')) AS term FROM units),
tf AS (SELECT job_id, record_id, term, count(*) AS n FROM occ GROUP BY job_id, record_id, term)"""

VOCAB = """vocab AS (
  SELECT job_id, term, dense_rank() OVER (PARTITION BY job_id ORDER BY term) - 1 AS position
  FROM (SELECT DISTINCT job_id, term FROM tf))"""

SQL: dict[str, str] = {}

SQL["attribute_scan"] = """
SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS record_id, text FROM documents"""

SQL["list_attribute_units"] = """
SELECT 'conversations' AS project_id, CAST(conv_id AS VARCHAR) AS record_id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sub_key,
       CAST(conv_id AS VARCHAR) || '@' || CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS VARCHAR) AS unit_key,
       text
FROM conversations"""

SQL["tokenize"] = """
WITH l AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS record_id,
                  regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS toks FROM documents)
SELECT project_id, record_id, 'text' AS attribute,
       CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS token_idx, unnest(toks) AS token
FROM l"""

SQL["boc_embed"] = "WITH " + CHAR_TF + ",\n" + VOCAB + """
SELECT tf.job_id, tf.record_id, vocab.position, round(CAST(tf.n AS DOUBLE), 6) + 0.0 AS value
FROM tf JOIN vocab USING (job_id, term)"""

SQL["bow_embed"] = "WITH " + WORD_TF + ",\n" + VOCAB + """
SELECT tf.job_id, tf.record_id, vocab.position, round(CAST(tf.n AS DOUBLE), 6) + 0.0 AS value
FROM tf JOIN vocab USING (job_id, term)"""

SQL["tfidf_embed"] = "WITH " + WORD_TF + """,
nu AS (SELECT job_id, count(*) AS n_units FROM units GROUP BY job_id),
dfs AS (SELECT job_id, term, count(*) AS df FROM tf GROUP BY job_id, term),
voc AS (SELECT dfs.job_id, term, dense_rank() OVER (PARTITION BY dfs.job_id ORDER BY term) - 1 AS position,
               ln((1.0 + n_units) / (1.0 + df)) + 1.0 AS idf
        FROM dfs JOIN nu USING (job_id)),
w AS (SELECT tf.job_id, tf.record_id, voc.position, tf.n * voc.idf AS w FROM tf JOIN voc USING (job_id, term))
SELECT job_id, record_id, position,
       round(w / sqrt(sum(w * w) OVER (PARTITION BY job_id, record_id)), 6) + 0.0 AS value
FROM w"""

SQL["split_long_text"] = """
WITH p AS (
  SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, text,
         CAST(ceil(length(text) / 200.0) AS INTEGER) AS n_parts FROM documents)
SELECT job_id, record_id, CAST(i AS INTEGER) AS part_idx, n_parts,
       length(substring(text, CAST(i * 200 + 1 AS BIGINT), 200)) AS part_len,
       substring(text, CAST(i * 200 + 1 AS BIGINT), 200) AS part
FROM p, range(0, n_parts) AS r(i)
WHERE n_parts > 0"""

# --- shared pieces -----------------------------------------------------------

from ..schema import (ERROR_CLASSES, MODEL_CATALOG, MSG_AZURE_KEY, MSG_COHERE_TOKEN,  # noqa: E402
                      MSG_FINISHED, MSG_INITIALIZING, MSG_OPENAI_KEY, MSG_RUNTIME, MSG_STARTED, MSG_TOKEN_TIMEOUT,
                      PLATFORMS, WARNING_TEMPLATES)
from ..sources.jobs import EXTRA_REQUESTS  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _arr(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


HASH_POS = "CAST(CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 256 AS INTEGER)"
HASH_SIGN = ("CASE WHEN CAST(('0x' || substr(md5(term), 9, 1)) AS INTEGER) < 8 "
             "THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END")
WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

EVENTS = f"""ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, ts,
         CASE event_type WHEN 'view' THEN 'INITIALIZING' WHEN 'click' THEN 'WAITING'
              WHEN 'signup' THEN 'ENCODING' WHEN 'purchase' THEN 'FINISHED' WHEN 'error' THEN 'FAILED' END AS state,
         ({_arr(PLATFORMS)})[CAST(((user_id % 5) + 5) % 5 + 1 AS BIGINT)] AS platform,
         ({_arr(ERROR_CLASSES)})[CAST(((CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) + 5) % 5 + 1 AS BIGINT)]
           AS error_class
  FROM events)"""

FAIL_MSG = f"""CASE WHEN error_class = 'connection' THEN 'connection failed at event ' || CAST(event_id AS VARCHAR)
     WHEN error_class IN ('invalid_key', 'not_found') AND platform = 'openai' THEN {_q(MSG_OPENAI_KEY)}
     WHEN error_class IN ('invalid_key', 'not_found') AND platform = 'azure' THEN {_q(MSG_AZURE_KEY)}
     WHEN error_class = 'invalid_token' THEN {_q(MSG_COHERE_TOKEN)}
     ELSE {_q(MSG_RUNTIME)} END"""

LABELLED = "doc_id IN (SELECT doc_id FROM labels)"

SQL["hashed_embed"] = "WITH " + DOC_UNITS + f""",
occ AS (SELECT job_id, record_id, unnest({WORDS.format('text')}) AS term FROM units),
h AS (SELECT job_id, record_id, {HASH_POS} AS position, {HASH_SIGN} AS s FROM occ),
b AS (SELECT job_id, record_id, position, sum(s) AS v FROM h GROUP BY job_id, record_id, position),
n AS (SELECT *, sum(v * v) OVER (PARTITION BY job_id, record_id) AS ss FROM b)
SELECT job_id, record_id, position, round(CASE WHEN ss > 0 THEN v / sqrt(ss) ELSE 0.0 END, 6) + 0.0 AS value FROM n"""

SQL["model_embed"] = f"""
WITH p AS (SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, text, length(text) AS total,
                  CAST(ceil(length(text) / 200.0) AS BIGINT) AS n_parts FROM documents),
parts AS (SELECT job_id, record_id, total, i, substring(text, CAST(i * 200 + 1 AS BIGINT), 200) AS part
          FROM (SELECT *, unnest(range(0, n_parts)) AS i FROM p WHERE n_parts > 0)),
occ AS (SELECT job_id, record_id, total, i, length(part) AS plen, unnest({WORDS.format('part')}) AS term FROM parts),
h AS (SELECT job_id, record_id, total, i, plen, {HASH_POS} AS position, {HASH_SIGN} AS s FROM occ),
b AS (SELECT job_id, record_id, total, i, plen, position, sum(s) AS v FROM h
      GROUP BY job_id, record_id, total, i, plen, position),
n AS (SELECT *, sum(v * v) OVER (PARTITION BY job_id, record_id, i) AS ss FROM b),
c AS (SELECT job_id, record_id, position,
             sum(plen * CASE WHEN ss > 0 THEN v / sqrt(ss) ELSE 0.0 END) / max(total) AS value
      FROM n GROUP BY job_id, record_id, position),
grid AS (SELECT job_id, record_id, CAST(unnest(range(0, 256)) AS INTEGER) AS position FROM p)
SELECT g.job_id, g.record_id, g.position, round(coalesce(c.value, 0.0), 6) + 0.0 AS value
FROM grid g LEFT JOIN c USING (job_id, record_id, position)"""

SQL["token_boc_embed"] = f"""
WITH l AS (SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, {WORDS.format('text')} AS toks FROM documents),
t AS (SELECT job_id, record_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS token_idx,
             unnest(toks) AS token FROM l),
occ AS (SELECT job_id, record_id, token_idx, unnest(regexp_extract_all(lower(token), '(?s).')) AS term FROM t),
tf AS (SELECT job_id, record_id, token_idx, term, count(*) AS n FROM occ GROUP BY job_id, record_id, token_idx, term),
{VOCAB}
SELECT tf.job_id, tf.record_id, tf.token_idx, vocab.position, round(CAST(tf.n AS DOUBLE), 6) + 0.0 AS value
FROM tf JOIN vocab USING (job_id, term)"""

_REQS = [(p, m) for (m, _, _, _, p) in MODEL_CATALOG] + EXTRA_REQUESTS
_REQ_VALUES = ", ".join(f"({_q(t)}, {_q(p)}, {_q(m)})" for t in ("ON_ATTRIBUTE", "ON_TOKEN") for (p, m) in _REQS)

SQL["job_resolve"] = f"""
WITH pc AS (SELECT source AS project_id, count(*) AS n_records FROM documents GROUP BY source),
req(type, platform, model) AS (VALUES {_REQ_VALUES}),
j AS (SELECT project_id || ':' || type || ':' || platform || ':' || model AS job_id, type, platform, model,
             n_records, type = 'ON_ATTRIBUTE' AS attr, n_records >= 64 AS big FROM pc, req),
k AS (SELECT *,
  CASE WHEN attr AND platform = 'python' AND model NOT IN ('bag-of-characters', 'bag-of-words', 'tf-idf')
         THEN 'Unknown model ' || model
       WHEN attr AND platform NOT IN ('python', 'openai', 'azure', 'huggingface', 'cohere')
         THEN 'Unknown platform ' || platform
       WHEN NOT attr AND model IN ('bag-of-words', 'tf-idf')
         THEN 'couldn''t find matching embedder for requested embedding with type ' || type || ' model ' || model
              || ' and platform ' || platform
  END AS error FROM j),
m AS (SELECT *,
  CASE WHEN attr AND platform = 'python' AND model = 'bag-of-characters' THEN 'bag_of_characters'
       WHEN attr AND platform = 'python' AND model = 'bag-of-words' THEN 'bag_of_words'
       WHEN attr AND platform = 'python' AND model = 'tf-idf' THEN 'tfidf'
       WHEN attr AND platform = 'python' THEN NULL
       WHEN attr AND platform IN ('openai', 'azure') THEN 'openai'
       WHEN attr AND platform = 'huggingface' THEN 'huggingface'
       WHEN attr AND platform = 'cohere' THEN 'cohere'
       WHEN attr THEN NULL
       WHEN model = 'bag-of-characters' THEN 'token_bag_of_characters'
       WHEN model IN ('bag-of-words', 'tf-idf') THEN NULL
       ELSE 'token_transformer' END AS embedder,
  CASE WHEN error IS NOT NULL THEN false
       WHEN attr AND platform = 'python' AND model IN ('bag-of-characters', 'tf-idf') THEN false
       WHEN attr THEN big
       WHEN model = 'bag-of-characters' THEN false
       ELSE true END AS reduce FROM k)
SELECT job_id, embedder,
       CAST(CASE WHEN error IS NOT NULL THEN NULL WHEN attr THEN 128 ELSE 32 END AS INTEGER) AS batch_size,
       CAST(CASE WHEN reduce AND attr THEN 64 WHEN reduce THEN 16 END AS INTEGER) AS n_components,
       reduce, error
FROM m"""

_CAT_VALUES = ", ".join(f"({_q(c)}, {_q(p)}, {str(a).lower()}, {str(k).lower()}, {_q(tok)})"
                        for (c, _, toks, (a, k), p) in MODEL_CATALOG for tok in toks)

SQL["model_recommend"] = f"""
WITH pl AS (SELECT source AS project_id, lang, count(*) AS n FROM documents GROUP BY source, lang),
pc AS (SELECT project_id, lang FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, lang DESC) AS rn FROM pl) WHERE rn = 1),
cat(config_string, platform, attribute_level, token_level, tokenizer) AS (VALUES {_CAT_VALUES}),
wanted AS (SELECT project_id, lang, 'all' AS tokenizer FROM pc
           UNION ALL
           SELECT project_id, lang, CASE lang WHEN 'en' THEN 'en_core_web_sm' WHEN 'de' THEN 'de_core_news_sm' END
           FROM pc WHERE lang IN ('en', 'de'))
SELECT project_id, lang, config_string, platform, attribute_level, token_level FROM wanted JOIN cat USING (tokenizer)"""

SQL["unit_count"] = """
SELECT project_id, count(*) AS expected FROM (
  SELECT source AS project_id FROM documents UNION ALL SELECT 'conversations' AS project_id FROM conversations)
GROUP BY project_id"""

SQL["vector_count"] = "SELECT source AS job_id, count(*) AS n_vectors FROM documents GROUP BY source"

SQL["unit_count_by_type"] = """
SELECT source AS project_id, name, count(*) AS expected
FROM documents, (VALUES ('doc_id'), ('text'), ('lang')) AS a(name) GROUP BY source, name
UNION ALL SELECT 'conversations', 'turns', count(*) FROM conversations"""

SQL["progress"] = """
WITH e AS (SELECT source AS job_id, count(*) AS expected,
                  count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_vectors
           FROM documents GROUP BY source),
s AS (SELECT *, CASE WHEN n_vectors * 2 < expected THEN 'INITIALIZING' ELSE 'ENCODING' END AS state FROM e)
SELECT job_id, state, n_vectors, expected,
       round(least(CAST(0.99 AS DOUBLE), CASE WHEN state = 'ENCODING' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
             + n_vectors / expected * CAST(0.9 AS DOUBLE)), 6) AS progress
FROM s"""

SQL["progress_by_batch"] = """
WITH e AS (SELECT source AS job_id, count(*) AS expected FROM documents GROUP BY source),
b AS (SELECT job_id, expected, unnest(range(-1, CAST(ceil(expected / 128.0) AS BIGINT))) AS batch FROM e),
n AS (SELECT job_id, expected, batch, least((batch + 1) * 128, expected) AS nv FROM b)
SELECT job_id, CAST(batch AS INTEGER) AS batch, CAST(nv AS BIGINT) AS n_vectors,
       round(least(CAST(0.99 AS DOUBLE), CAST(0.1 AS DOUBLE)
             + CASE WHEN expected > 0 THEN nv / expected * CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6)
         AS progress
FROM n"""

SQL["tokenization_progress"] = f"""
WITH r AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS record_id, text FROM documents),
s AS (SELECT project_id, count(*) AS n_records,
             count(*) FILTER (WHERE len({WORDS.format('text')}) > 0) AS n_tokenized FROM r GROUP BY project_id)
SELECT project_id, n_records, n_tokenized,
       CASE WHEN n_tokenized / n_records < 1 THEN round(n_tokenized / n_records, 6) END AS progress,
       n_tokenized / n_records >= 1 AS ready
FROM s"""

SQL["batch_plan"] = """
SELECT job_id, record_id, pos, CAST(pos // 128 AS BIGINT) AS batch FROM (
  SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id,
         row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS pos
  FROM documents)"""

SQL["token_mismatch"] = f"""
SELECT project_id, record_id, n_tokens, n_vectors FROM (
  SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS record_id,
         CAST(len({WORDS.format('text')}) AS BIGINT) AS n_tokens,
         CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_vectors
  FROM documents)
WHERE n_tokens <> n_vectors"""


def _warning_sql(wtype: str) -> str:
    t = _q(WARNING_TEMPLATES[wtype])
    return (t.replace("{record_number}", "' || CAST(record_number AS VARCHAR) || '")
             .replace("{example_record_msg}", "' || ex || '"))


SQL["warning_report"] = f"""
WITH r AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS record_id, text FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY record_id) - 1 AS pos FROM r),
w AS (SELECT project_id, record_id, 'DOCUMENT_IS_SPLITTED' AS warning_type, pos FROM ranked WHERE length(text) > 200
      UNION ALL
      SELECT project_id, record_id, 'TOKEN_MISMATCHING' AS warning_type, pos FROM ranked
      WHERE len({WORDS.format('text')}) <> len(regexp_extract_all(text, '\\S+'))),
a AS (SELECT project_id, warning_type, count(DISTINCT record_id) AS record_number,
             arg_max(record_id, pos) AS example_record_id FROM w GROUP BY project_id, warning_type),
e AS (SELECT *, 'with primary key: ' || example_record_id AS ex FROM a)
SELECT project_id, warning_type, record_number, example_record_id,
       CASE warning_type WHEN 'DOCUMENT_IS_SPLITTED' THEN {_warning_sql('DOCUMENT_IS_SPLITTED')}
                         ELSE {_warning_sql('TOKEN_MISMATCHING')} END AS message
FROM e"""

SQL["job_latest_state"] = f"""
WITH {EVENTS}
SELECT job_id, state, ts FROM (
  SELECT job_id, state, max(ts) OVER (PARTITION BY job_id) AS ts,
         row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev)
WHERE rn = 1"""

SQL["failure_report"] = f"""
WITH {EVENTS},
l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev)
SELECT job_id, platform, error_class, {FAIL_MSG} AS message, ts AS failed_at
FROM l WHERE rn = 1 AND state = 'FAILED'"""

SQL["cancel_cut"] = f"""
WITH {EVENTS},
ff AS (SELECT job_id, min(ts) AS first_failed FROM ev WHERE state = 'FAILED' GROUP BY job_id),
w AS (SELECT job_id, ts FROM ev WHERE state = 'ENCODING')
SELECT w.job_id,
       CAST(sum(CASE WHEN ff.first_failed IS NULL OR w.ts < ff.first_failed THEN 1 ELSE 0 END) AS BIGINT) AS kept_batches,
       CAST(sum(CASE WHEN ff.first_failed IS NULL OR w.ts < ff.first_failed THEN 0 ELSE 1 END) AS BIGINT) AS cut_batches,
       min(ff.first_failed) AS first_failed
FROM w LEFT JOIN ff USING (job_id) GROUP BY w.job_id"""

SQL["vector_count_check"] = f"""
SELECT source AS job_id, count(*) AS n_changes, count(*) AS n_vectors, true AS ok
FROM documents WHERE {LABELLED} GROUP BY source"""

SQL["job_event_append"] = f"""
WITH {EVENTS}
SELECT event_id, CAST(0 AS INTEGER) AS seq, 'events:embedding:' || job_id || ':state:' || state AS message FROM ev
UNION ALL
SELECT event_id, CAST(1 AS INTEGER) AS seq, 'GLOBAL:notification_created:' || job_id AS message FROM ev
WHERE state <> 'WAITING'"""


def _fmt(t: str) -> str:
    return _q(t).replace("{model}", "' || platform || '").replace("{attribute}", "' || 'text' || '")


SQL["notification_append"] = f"""
WITH {EVENTS}
SELECT event_id, job_id,
       CASE WHEN state IN ('INITIALIZING', 'ENCODING') THEN 'INFO' WHEN state = 'FINISHED' THEN 'SUCCESS'
            ELSE 'ERROR' END AS level,
       CASE WHEN state IN ('INITIALIZING', 'ENCODING') THEN 'EMBEDDING_CREATION_STARTED'
            WHEN state = 'FINISHED' THEN 'EMBEDDING_CREATION_DONE' ELSE 'EMBEDDING_CREATION_FAILED' END AS type,
       CASE WHEN state = 'INITIALIZING' THEN {_fmt(MSG_INITIALIZING)}
            WHEN state = 'ENCODING' THEN {_fmt(MSG_STARTED)}
            WHEN state = 'FINISHED' THEN {_fmt(MSG_FINISHED)}
            ELSE {FAIL_MSG} END AS message
FROM ev WHERE state <> 'WAITING'"""

SQL["change_scan"] = f"""
SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, 'text' AS attribute_name,
       CAST(NULL AS INTEGER) AS sub_key
FROM documents WHERE {LABELLED}"""

SQL["change_filter"] = SQL["change_scan"]

SQL["record_lookup"] = f"""
SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS record_id, reverse(text) AS text
FROM documents WHERE {LABELLED}"""

SQL["changes_x_records"] = f"""
SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, reverse(text) AS text
FROM documents WHERE {LABELLED}"""

SQL["order_preserving_lookup"] = f"""
SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, reverse(text) AS text,
       row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS position
FROM documents WHERE {LABELLED}"""

SQL["list_entry_project"] = """
SELECT record_id, sub_key, text FROM (
  SELECT CAST(conv_id AS VARCHAR) AS record_id, role, text,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sub_key
  FROM conversations)
WHERE role = 'assistant'"""

SQL["token_scan"] = f"""
WITH l AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS record_id, {WORDS.format('text')} AS toks
           FROM documents WHERE {LABELLED})
SELECT project_id, record_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS token_idx, unnest(toks) AS token
FROM l"""

# --- sinks read back -------------------------------------------------------------

CHARS = "regexp_extract_all(lower({0}), '(?s).')"
DOCS_LAB = f"""d AS (SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, text,
                  {LABELLED} AS lab FROM documents)"""

SQL["vector_append"] = f"""
WITH {DOCS_LAB},
occ AS (SELECT job_id, unnest({CHARS.format('text')}) AS ch FROM d),
w AS (SELECT job_id, count(DISTINCT ch) AS n_dims FROM occ GROUP BY job_id)
SELECT d.job_id, d.record_id, w.n_dims, CAST(len({CHARS.format('d.text')}) AS BIGINT) AS vsum
FROM d JOIN w USING (job_id)"""

SQL["vector_replace_job"] = f"""
WITH {DOCS_LAB},
jl AS (SELECT job_id, bool_or(lab) AS has FROM d GROUP BY job_id)
SELECT d.job_id, d.record_id, CAST(len({CHARS.format('d.text')}) AS BIGINT) AS vsum
FROM d JOIN jl USING (job_id) WHERE d.lab OR NOT jl.has"""

SQL["vector_delete_records"] = f"""
WITH {DOCS_LAB}
SELECT job_id, record_id, CAST(len({CHARS.format('text')}) AS BIGINT) AS vsum FROM d WHERE NOT lab"""

SQL["vector_delete_subkeys"] = f"""
SELECT job_id, record_id, sub_key, vsum FROM (
  SELECT 'conversations' AS job_id, CAST(conv_id AS VARCHAR) AS record_id, role,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sub_key,
         CAST(len({CHARS.format('text')}) AS BIGINT) AS vsum
  FROM conversations)
WHERE role <> 'assistant'"""

SQL["vector_upsert"] = f"""
SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, CAST(len({CHARS.format('text')}) AS BIGINT) AS vsum
FROM documents"""

SQL["vector_export"] = SQL["vector_upsert"]
SQL["vector_scan_ordered"] = f"""
SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, CAST(len({CHARS.format('text')}) AS BIGINT) AS vsum,
       row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS place
FROM documents"""

SQL["vector_upsert"] = f"""
SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id,
       CAST(len({CHARS.format("text || CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'eee' ELSE '' END")}) AS BIGINT) AS vsum
FROM documents"""

SQL["vector_snapshot"] = f"""
SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, CAST(len({CHARS.format("text")}) AS BIGINT) AS vsum_before,
       CAST(len({CHARS.format("text || CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'eee' ELSE '' END")}) AS BIGINT)
           AS vsum_after
FROM documents"""

SQL["export_policy"] = "SELECT source AS job_id, count(*) AS n_rows FROM documents GROUP BY source"

SQL["search_collection_build"] = f"""
WITH {DOCS_LAB},
occ AS (SELECT job_id, record_id, unnest({CHARS.format('text')}) AS ch FROM d),
tf AS (SELECT job_id, record_id, ch, count(*) AS n FROM occ GROUP BY job_id, record_id, ch),
s AS (SELECT job_id, record_id, sum(n) AS s1, sum(n * n) AS s2 FROM tf GROUP BY job_id, record_id)
SELECT d.job_id, d.record_id,
       round(CASE WHEN coalesce(s.s2, 0) > 0 THEN s.s1 / sqrt(s.s2) ELSE 0.0 END, 6) + 0.0 AS unit_sum
FROM d LEFT JOIN s USING (job_id, record_id)"""

SQL["search_collection_drop"] = SQL["export_policy"]

SQL["job_delete"] = """
SELECT 'vectors' AS kind, source AS job_id, count(*) AS n_rows FROM documents GROUP BY source
UNION ALL SELECT 'vectors', 'conversations', count(*) FROM conversations
UNION ALL SELECT 'exports', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'collection', source, count(*) FROM documents GROUP BY source"""

SQL["model_save_load"] = SQL["tfidf_embed"]

SQL["transform"] = "WITH " + WORD_TF + ",\n" + VOCAB + f""",
ed AS (SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, reverse(text) AS text
       FROM documents WHERE {LABELLED}),
occ2 AS (SELECT job_id, record_id, unnest({WORDS.format('text')}) AS term FROM ed),
tf2 AS (SELECT job_id, record_id, term, count(*) AS n FROM occ2 GROUP BY job_id, record_id, term)
SELECT tf2.job_id, tf2.record_id, vocab.position, round(CAST(tf2.n AS DOUBLE), 6) + 0.0 AS value
FROM tf2 JOIN vocab USING (job_id, term)"""

SQL["score_texts"] = f"""
WITH units AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, text FROM documents),
occ AS (SELECT record_id, unnest({WORDS.format('text')}) AS term FROM units),
tf AS (SELECT record_id, term, count(*) AS n FROM occ GROUP BY record_id, term),
nu AS (SELECT count(*) AS n_units FROM units),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
voc AS (SELECT term, dense_rank() OVER (ORDER BY term) - 1 AS position,
               ln((1.0 + n_units) / (1.0 + df)) + 1.0 AS idf FROM dfs, nu),
b AS (SELECT CAST(item_id AS VARCHAR) AS record_id, unnest({WORDS.format('text')}) AS term FROM benchmark),
btf AS (SELECT record_id, term, count(*) AS n FROM b GROUP BY record_id, term),
w AS (SELECT record_id, position, n * idf AS w FROM btf JOIN voc USING (term))
SELECT record_id, position, round(w / sqrt(sum(w * w) OVER (PARTITION BY record_id)), 6) + 0.0 AS value FROM w"""

SQL["fit_transform"] = f"""
WITH u AS (SELECT 'conversations' AS job_id, CAST(conv_id AS VARCHAR) AS record_id,
                  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sub_key, text
           FROM conversations),
occ AS (SELECT job_id, record_id, sub_key, unnest({WORDS.format('text')}) AS term FROM u),
tf AS (SELECT job_id, record_id, sub_key, term, count(*) AS n FROM occ GROUP BY job_id, record_id, sub_key, term),
{VOCAB}
SELECT tf.job_id, tf.record_id, tf.sub_key, vocab.position, round(CAST(tf.n AS DOUBLE), 6) + 0.0 AS value
FROM tf JOIN vocab USING (job_id, term)"""

SQL["encode_job"] = """
SELECT source AS job_id, count(*) AS n_vectors, count(*) AS n_exported, count(*) AS n_indexed,
       'FINISHED' AS state
FROM documents GROUP BY source"""

SQL["re_embed"] = f"""
WITH {DOCS_LAB},
vocab AS (SELECT DISTINCT job_id, unnest({WORDS.format('text')}) AS term FROM d),
cur AS (SELECT job_id, record_id, CASE WHEN lab THEN reverse(text) ELSE text END AS text FROM d),
occ AS (SELECT job_id, record_id, unnest({WORDS.format('text')}) AS term FROM cur),
hits AS (SELECT occ.job_id, occ.record_id, count(*) AS n FROM occ JOIN vocab USING (job_id, term)
         GROUP BY occ.job_id, occ.record_id)
SELECT cur.job_id, cur.record_id, CAST(coalesce(hits.n, 0) AS BIGINT) AS vsum
FROM cur LEFT JOIN hits USING (job_id, record_id)"""

SQL["re_embed_saved"] = f"""
WITH {DOCS_LAB},
r AS (SELECT record_id, text, lab, row_number() OVER (PARTITION BY lab ORDER BY record_id) - 1 AS n FROM d),
c AS (SELECT count(*) AS total FROM d WHERE NOT lab),
cur AS (SELECT record_id, text, lab FROM r WHERE NOT lab
        UNION ALL SELECT a.record_id, b.text, a.lab FROM r a, c JOIN r b ON NOT b.lab WHERE a.lab AND b.n = a.n % c.total),
w AS (SELECT lab, {WORDS.format('text')} AS toks FROM cur),
whole AS (SELECT count(*) AS n_vectors, CAST(count(*) FILTER (WHERE lab) AS BIGINT) AS n_changed FROM cur),
tok AS (SELECT CAST(sum(len(toks)) AS BIGINT) AS n_vectors,
               CAST(coalesce(sum(len(toks)) FILTER (WHERE lab), 0) AS BIGINT) AS n_changed FROM w),
old_words AS (SELECT unnest({WORDS.format('text')}) AS term FROM d),
widths(job_id, width) AS (
  SELECT 'characters', (SELECT count(DISTINCT ch) FROM (SELECT unnest({CHARS.format('text')}) AS ch FROM d))
  UNION ALL SELECT 'tf-idf', (SELECT count(DISTINCT term) FROM old_words)
  UNION ALL SELECT 'reduced-words', 64 UNION ALL SELECT 'reduced-model', 64
  UNION ALL SELECT 'tokens', (SELECT count(DISTINCT ch) FROM (SELECT unnest({CHARS.format('term')}) AS ch FROM old_words)))
SELECT job_id, n_vectors, n_changed, n_changed AS n_like_twin, n_vectors - n_changed AS n_kept, width
FROM widths JOIN whole ON job_id <> 'tokens'
UNION ALL SELECT job_id, n_vectors, n_changed, n_changed, n_vectors - n_changed, width FROM widths JOIN tok ON job_id = 'tokens'"""

SQL["score_saved"] = SQL["score_texts"]

SQL["encode_cancelled"] = f"""
WITH l AS (SELECT source, CAST(doc_id AS VARCHAR) AS record_id, {WORDS.format('text')} AS toks FROM documents),
t AS (SELECT source, record_id, generate_subscripts(toks, 1) AS token_idx, unnest(toks) AS token FROM l),
b AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY record_id, token_idx) - 1) // 32 AS batch FROM t),
k AS (SELECT *, batch * 4 // (max(batch) OVER (PARTITION BY source) + 1) AS number FROM b),
s AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) % 2 = 1 AS cut FROM (SELECT DISTINCT source FROM documents))
SELECT source || ':ON_TOKEN:python:bag-of-characters' AS job_id, count(*) AS n_vectors,
       CAST(sum(len({CHARS.format('token')})) AS BIGINT) AS n_chars,
       CASE WHEN cut THEN 'FAILED' ELSE 'FINISHED' END AS state, CASE WHEN cut THEN 'FAILED' ELSE 'FINISHED' END AS last_state
FROM k JOIN s USING (source) WHERE NOT cut OR number < 2 GROUP BY source, cut"""

# --- PCA, sketch, k-NN ----------------------------------------------------------------

EMB = """e AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i,
                  unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"""

SQL["pca_fit"] = f"""
WITH {EMB},
p AS (SELECT a.i AS i, b.i AS j, a.x AS xa, b.x AS xb FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i)
SELECT i, j, round(covar_samp(xa, xb), 6) + 0.0 AS cov FROM p GROUP BY i, j"""

SQL["pca_transform"] = f"""
WITH {EMB},
m AS (SELECT i, avg(x) AS mu FROM e GROUP BY i)
SELECT CAST(vec_id AS VARCHAR) AS record_id, round(sum((x - mu) * (x - mu)), 4) AS sq_norm
FROM e JOIN m USING (i) GROUP BY vec_id"""

SQL["seeded_projection"] = "WITH " + WORD_TF + """,
jobs AS (SELECT DISTINCT job_id FROM units),
jb AS (SELECT job_id, length(job_id) AS n, i, unicode(substr(job_id, CAST(i + 1 AS BIGINT), 1)) AS b
       FROM (SELECT job_id, unnest(range(length(job_id))) AS i FROM jobs)),
seeds AS (SELECT job_id, ((max(n) + sum((n - i) * b)) % 65521) * 65536 + ((1 + sum(b)) % 65521) AS seed
          FROM jb GROUP BY job_id),
hx AS (SELECT DISTINCT tf.job_id, tf.term, md5(CAST(seeds.seed AS VARCHAR) || ':' || tf.term) AS hex
       FROM tf JOIN seeds USING (job_id)),
sk AS (SELECT tf.job_id, tf.record_id, CAST(r.j AS INTEGER) AS j,
              sum(tf.n * (1 - 2 * ((CAST(('0x' || substr(hx.hex, CAST(r.j // 4 + 1 AS BIGINT), 1)) AS INTEGER)
                                    >> CAST(3 - r.j % 4 AS INTEGER)) & 1))) AS v
       FROM tf JOIN hx USING (job_id, term), range(0, 80) AS r(j)
       GROUP BY tf.job_id, tf.record_id, r.j),
grid AS (SELECT job_id, record_id, CAST(unnest(range(0, 80)) AS INTEGER) AS j FROM units)
SELECT g.job_id, g.record_id, g.j, round(CAST(coalesce(sk.v, 0) AS DOUBLE), 6) + 0.0 AS value
FROM grid g LEFT JOIN sk USING (job_id, record_id, j)"""

SQL["knn_topk"] = """
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.id AS query_id, b.id AS neighbor_id,
             round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)
               AS score
      FROM e a JOIN e b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score + 0.0 AS score FROM r WHERE rank <= 10"""

# --- streams --------------------------------------------------------------------------

SQL["throttle_by_key"] = """
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
pass(event_id, user_id, ts) AS (
  SELECT event_id, user_id, ts FROM ev WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, ts FROM (
    SELECT e.event_id, e.user_id, e.ts,
           row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS r
    FROM pass p JOIN ev e ON e.user_id = p.user_id AND e.ts > p.ts + INTERVAL 1 HOUR)
  WHERE r = 1)
SELECT event_id, user_id, ts FROM pass"""

SQL["throttle_stream"] = SQL["throttle_by_key"]

SQL["job_state_stream"] = SQL["job_latest_state"]

SQL["token_gate_timeout"] = f"""
WITH {EVENTS},
w AS (SELECT job_id, min(ts) AS t0 FROM ev WHERE state = 'WAITING' GROUP BY job_id),
r AS (SELECT ev.job_id, min(ev.ts) AS ready_at FROM ev JOIN w USING (job_id)
      WHERE ev.state = 'ENCODING' AND ev.ts > w.t0 GROUP BY ev.job_id),
j AS (SELECT w.job_id, w.t0, r.ready_at,
             CAST(ceil((epoch_us(r.ready_at) - epoch_us(w.t0)) / 30000000.0) AS BIGINT) AS c
      FROM w LEFT JOIN r USING (job_id))
SELECT job_id, t0, ready_at,
       CASE WHEN ready_at IS NOT NULL AND c < 40 THEN 'ENCODING' ELSE 'FAILED' END AS outcome,
       CASE WHEN ready_at IS NOT NULL AND c < 40 THEN c ELSE 40 END AS checks,
       make_timestamp(CASE WHEN ready_at IS NOT NULL AND c < 40 THEN epoch_us(t0) + c * 30000000
                           ELSE epoch_us(t0) + 40 * 30000000 END) AS decided_at
FROM j"""

SQL["token_gate_stream"] = f"""
WITH g AS ({SQL["token_gate_timeout"]})
SELECT job_id, t0, CASE WHEN outcome = 'ENCODING' THEN ready_at END AS ready_at, outcome, checks, decided_at,
       CASE WHEN outcome = 'FAILED' THEN {_q(MSG_TOKEN_TIMEOUT)} END AS message
FROM g"""

SQL["encode_jobs_gated"] = f"""
WITH p AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars,
                  CAST(sum(len({WORDS.format('text')})) AS BIGINT) AS n_tokens FROM documents GROUP BY source),
t AS (SELECT CAST(sum(chars) AS BIGINT) AS total, count(*) AS n FROM p),
g AS (SELECT source || ':ON_TOKEN:python:bag-of-characters' AS job_id, n_tokens,
             ceil((1200 * n * chars // total) / 30.0) < 40 AS ready FROM p, t)
SELECT job_id, CASE WHEN ready THEN '0 INITIALIZING, 1 WAITING, 2 ENCODING, 3 FINISHED'
                    ELSE '0 INITIALIZING, 1 WAITING, 3 FAILED' END AS states,
       CASE WHEN ready THEN n_tokens ELSE 0 END AS n_vectors,
       CASE WHEN ready THEN 'Finished encoding text using model bag-of-characters.' ELSE {_q(MSG_TOKEN_TIMEOUT)} END AS message
FROM g"""

SQL["re_embed_stream"] = SQL["re_embed"]

SQL["re_embed_stream_lists"] = f"""
WITH e AS (SELECT 'conversations' AS job_id, CAST(conv_id AS VARCHAR) AS record_id, role, text,
                  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS sub_key FROM conversations),
vocab AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS term FROM e),
cur AS (SELECT job_id, record_id, sub_key, CASE WHEN role = 'assistant' THEN reverse(text) ELSE text END AS text FROM e),
occ AS (SELECT record_id, sub_key, unnest({WORDS.format('text')}) AS term FROM cur),
hits AS (SELECT record_id, sub_key, count(*) AS n FROM occ JOIN vocab USING (term) GROUP BY record_id, sub_key)
SELECT cur.job_id, cur.record_id, cur.sub_key, CAST(coalesce(hits.n, 0) AS BIGINT) AS vsum,
       (SELECT count(*) FROM e WHERE role = 'assistant') AS n_changes
FROM cur LEFT JOIN hits USING (record_id, sub_key)"""

SQL["score_stream"] = SQL["score_texts"]

SQL["warnings_x_records"] = f"""
WITH r AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS record_id, text FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY record_id) - 1 AS pos FROM r),
w AS (SELECT project_id, record_id, 'DOCUMENT_IS_SPLITTED' AS warning_type, pos FROM ranked WHERE length(text) > 200
      UNION ALL
      SELECT project_id, record_id, 'TOKEN_MISMATCHING' AS warning_type, pos FROM ranked
      WHERE len({WORDS.format('text')}) <> len(regexp_extract_all(text, '\\S+')))
SELECT project_id, warning_type, arg_max(record_id, pos) AS example_record_id,
       arg_max(record_id, pos) AS pk_values
FROM w GROUP BY project_id, warning_type"""

SQL["bow_pca_invariants"] = f"""
WITH occ AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n FROM occ GROUP BY doc_id, term),
t AS (SELECT sum(n) AS s, sum(n * n) AS ss FROM tf GROUP BY term)
SELECT 'corpus' AS job_id, (SELECT count(*) FROM documents) AS n_units, CAST(64 AS BIGINT) AS n_components,
       CAST(0 AS DOUBLE) AS worst_mean, CAST(0 AS DOUBLE) AS worst_correlation,
       round(sum(ss - s * s / (SELECT count(*) FROM documents)), 2) AS total, true AS captured_within_total
FROM t"""

SQL["reduced_model_save_load"] = """
SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST(64 AS INTEGER) AS n_components FROM documents"""

SQL["token_model_vectors"] = f"""
WITH l AS (SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS record_id, {WORDS.format('text')} AS toks FROM documents),
t AS (SELECT job_id, record_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS token_idx, unnest(toks) AS token FROM l),
c AS (SELECT job_id, record_id, token_idx, concat_ws(' ', lag(token) OVER w, token, lead(token) OVER w) AS text
      FROM t WINDOW w AS (PARTITION BY job_id, record_id ORDER BY token_idx)),
p AS (SELECT *, length(text) AS total, CAST(ceil(length(text) / 200.0) AS BIGINT) AS n_parts FROM c),
parts AS (SELECT job_id, record_id, token_idx, total, i, substring(text, CAST(i * 200 + 1 AS BIGINT), 200) AS part
          FROM (SELECT *, unnest(range(0, n_parts)) AS i FROM p)),
occ AS (SELECT job_id, record_id, token_idx, total, i, length(part) AS plen, unnest({WORDS.format('part')}) AS term FROM parts),
h AS (SELECT *, {HASH_POS} AS position, {HASH_SIGN} AS s FROM occ),
b AS (SELECT job_id, record_id, token_idx, total, i, plen, position, sum(s) AS v FROM h
      GROUP BY job_id, record_id, token_idx, total, i, plen, position),
n AS (SELECT *, sum(v * v) OVER (PARTITION BY job_id, record_id, token_idx, i) AS ss FROM b),
v AS (SELECT job_id, record_id, token_idx, position,
             sum(plen * CASE WHEN ss > 0 THEN v / sqrt(ss) ELSE 0.0 END) / max(total) AS value
      FROM n GROUP BY job_id, record_id, token_idx, position)
SELECT job_id, record_id, token_idx, position, round(value, 6) + 0.0 AS value FROM v WHERE value <> 0"""

SQL["encode_jobs"] = f"""
WITH p AS (SELECT source, count(*) AS n_docs, CAST(sum(len({WORDS.format('text')})) AS BIGINT) AS n_tokens
           FROM documents GROUP BY source),
r(type, platform, model) AS (VALUES ('ON_ATTRIBUTE', 'python', 'bag-of-characters'),
  ('ON_ATTRIBUTE', 'openai', 'text-embedding-3-small'), ('ON_ATTRIBUTE', 'azure', 'text-embedding-3-small'),
  ('ON_ATTRIBUTE', 'python', 'word2vec'), ('ON_ATTRIBUTE', 'unknown-platform', 'some-model'),
  ('ON_TOKEN', 'python', 'bag-of-characters'), ('ON_TOKEN', 'python', 'tf-idf')),
j AS (SELECT source || ':' || type || ':' || platform || ':' || model AS job_id, *,
  CASE WHEN model = 'word2vec' THEN 'Error while getting model - Unknown model word2vec'
       WHEN platform = 'unknown-platform' THEN 'Error while getting model - Unknown platform unknown-platform'
       WHEN model = 'tf-idf' THEN 'Error while getting model - couldn''t find matching embedder for requested embedding with type '
                                  || type || ' model ' || model || ' and platform ' || platform
       WHEN platform = 'azure' THEN {_q(MSG_AZURE_KEY)} END AS failure FROM p, r)
SELECT job_id, CASE WHEN failure IS NULL THEN 'FINISHED' ELSE 'FAILED' END AS state,
       CASE WHEN failure IS NOT NULL THEN 0 WHEN type = 'ON_TOKEN' THEN n_tokens ELSE n_docs END AS n_vectors,
       CASE WHEN failure IS NULL THEN 'SUCCESS' ELSE 'ERROR' END AS level,
       coalesce(failure, 'Finished encoding text using model ' || model || '.') AS message
FROM j"""
