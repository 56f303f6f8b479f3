"""Schemas of the engine's tables and the fixed values it must reproduce."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced; they are
# stated here as plain text, in their natural order, in one place.
# ---------------------------------------------------------------------------

# Embedding types, platforms and job states.
ON_ATTRIBUTE = "ON_ATTRIBUTE"
ON_TOKEN = "ON_TOKEN"
PLATFORMS = ("python", "openai", "azure", "huggingface", "cohere")
STATES = ("INITIALIZING", "WAITING", "ENCODING", "FINISHED", "FAILED")

# Attribute data type of list attributes.
EMBEDDING_LIST = "EMBEDDING_LIST"

# Built-in count models.
BOC = "bag-of-characters"
BOW = "bag-of-words"
TFIDF = "tf-idf"
REDUCED_BOW = "bag-of-words-pca"   # name under which a reduced bag of words is stored
MODEL_PCA = "model-pca"            # name under which the components of a model's vectors are stored

# Dispatch constants: batch sizes, PCA widths, the PCA record threshold.
DOC_BATCH = 128
TOKEN_BATCH = 32
DOC_COMPONENTS = 64
TOKEN_COMPONENTS = 16
AZURE_REQUEST_CAP = 16

# Export chunking, progress throttle period, token gate.
EXPORT_CHUNK_ROWS = 100
PROGRESS_PERIOD_SECONDS = 5
TOKEN_WAIT_CHECKS = 40
TOKEN_WAIT_SECONDS = 30

# Warning types and their message templates.
DOCUMENT_IS_SPLITTED = "DOCUMENT_IS_SPLITTED"
TOKEN_MISMATCHING = "TOKEN_MISMATCHING"
WARNING_TEMPLATES = {
    DOCUMENT_IS_SPLITTED: (
        "For {record_number} records, the text length exceeds the model's max input"
        " length. For these records, the texts are splitted and the parts are processed"
        " individually. For example, record {example_record_msg}."
    ),
    TOKEN_MISMATCHING: (
        "For {record_number} records, the number of embeddings does not match the "
        "number of spacy tokens. Please contact support. For example, record "
        "{example_record_msg}."
    ),
}
EXAMPLE_WITH_PK = "with primary key: "
EXAMPLE_WITH_ID = " with record id: "

# Notification levels and types.
LEVELS = ("INFO", "WARNING", "ERROR", "SUCCESS")
NOTE_STARTED = "EMBEDDING_CREATION_STARTED"
NOTE_WARNING = "EMBEDDING_CREATION_WARNING"
NOTE_FAILED = "EMBEDDING_CREATION_FAILED"
NOTE_DONE = "EMBEDDING_CREATION_DONE"

# Notification texts.
MSG_INITIALIZING = "Initializing model {model}. This can take a few minutes."
MSG_STARTED = "Started encoding {attribute} using model {model}."
MSG_FINISHED = "Finished encoding {attribute} using model {model}."
MSG_MODEL_ERROR = "Error while getting model - {error}"
MSG_TOKEN_TIMEOUT = ("Tokenization still in progress, aborting embedding creation. "
                     "Please contact the support or retry later.")
MSG_RUNTIME = "Error at runtime. Please contact support."
MSG_OPENAI_KEY = "Access denied due to invalid api key."
MSG_AZURE_KEY = "Access denied due to invalid subscription key or wrong endpoint data."
MSG_COHERE_TOKEN = "Access denied due to invalid api token."

# Provider error texts that select the short messages above.
ERR_OPENAI_KEY = ("OpenAI API key is invalid. Please provide a valid API key in the "
                  "constructor of OpenAISentenceEmbedder.")
ERR_NOT_FOUND = "Resource not found"
ERR_COHERE_TOKEN = "invalid api token"

# Error classes carried by model_embed rows.
ERROR_CLASSES = ("connection", "invalid_key", "not_found", "invalid_token", "general")

# Model catalog: config_string, description, tokenizers, (attribute, token), platform.
MODEL_CATALOG = [
    ("distilbert-base-uncased", "Lightweight generic embedding for English texts",
     ["en_core_web_sm"], (True, True), "huggingface"),
    ("bert-base-uncased", "Generic embedding for English texts",
     ["en_core_web_sm"], (True, True), "huggingface"),
    ("roberta-base", "Generic embedding for English texts",
     ["en_core_web_sm"], (True, True), "huggingface"),
    ("symanto/xlm-roberta-base-snli-mnli-anli-xnli", "Few-shot optimimized embedding for English texts",
     ["en_core_web_sm"], (True, True), "huggingface"),
    ("bert-base-german-cased", "Generic transformer for German texts",
     ["de_core_news_sm"], (True, True), "huggingface"),
    ("deepset/gbert-base", "Generic transformer for German texts",
     ["de_core_news_sm"], (True, True), "huggingface"),
    ("oliverguhr/german-sentiment-bert", "Sentiment classification for German texts",
     ["de_core_news_sm"], (True, True), "huggingface"),
    ("bag-of-characters", "Simple count of characters",
     ["all"], (True, True), "python"),
    ("bag-of-words", "Simple count of words; PCA reduced",
     ["all"], (True, False), "python"),
    ("tf-idf", "Term frequency - inverse document frequency; PCA reduced",
     ["all"], (True, False), "python"),
    ("text-embedding-3-small", "Cheap and reliable transformer",
     ["all"], (True, False), "openai"),
    ("text-embedding-3-large", "Slower and more expensive model with better overall performance",
     ["all"], (True, False), "openai"),
    ("text-embedding-ada-002", "Most common used openai transformer (outdated)",
     ["all"], (True, False), "openai"),
]

# Tokenizer per language code (used to pick catalog models for a corpus).
LANGUAGE_TOKENIZERS = [("en", "en_core_web_sm"), ("de", "de_core_news_sm")]

# ---------------------------------------------------------------------------
# Engine choices (not fixed by the reproduced behaviour).
# ---------------------------------------------------------------------------

WORD_PATTERN = r"[\p{L}\p{N}]+"
CHAR_PATTERN = r"(?s)."
HASH_DIM = 256
SPLIT_CHARS = 200
ROUND_PLACES = 6

# ---------------------------------------------------------------------------
# Table schemas.
# ---------------------------------------------------------------------------

UNITS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("sub_key", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

VECTORS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("sub_key", T.IntegerType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
])

JOBS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("attribute_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("model", T.StringType()),
])

ATTRIBUTES = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("attribute_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("is_primary_key", T.BooleanType()),
])

JOB_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("state", T.StringType()),
])

CHANGE_ENTRY = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("attribute_name", T.StringType()),
    T.StructField("sub_key", T.StringType()),
])
CHANGE_SET = T.MapType(T.StringType(), T.ArrayType(CHANGE_ENTRY))

CATALOG = T.StructType([
    T.StructField("config_string", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("tokenizers", T.ArrayType(T.StringType())),
    T.StructField("applicability", T.StructType([
        T.StructField("attribute", T.BooleanType()),
        T.StructField("token", T.BooleanType()),
    ])),
    T.StructField("platform", T.StringType()),
])
