"""A training-corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; ``run`` writes each result as Parquet below the checkpoint
folder and reads it again for the next. Stages 1 to 4 return the columns of
documents (stage 3 with the repeated bytes cut out of the texts and n_chars
counted anew); the last returns the pieces of the packed sequences.

No stage can be put into SQL, so ORACLE_SQL is None; tests compare each stage
with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, packing, simhash, suffixes
from tessera.llm.frames import staged, table
from tessera.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified (null, or without letters) go."""
    return language.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_representatives(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that repeat are cut out of the texts; documents with nothing left go."""
    cut = suffixes.cut_repeats(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.where("text <> ''").withColumn("n_chars", length)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup),
          ("suffix_array_dedup", suffix_array_dedup), ("benchmark_decontamination", benchmark_decontamination),
          ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
