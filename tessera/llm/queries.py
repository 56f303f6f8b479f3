"""Registered queries of the llm operators: each applies one operator to its whole table."""

from __future__ import annotations

from . import alignment, decontaminate, fingerprints, html, language, packing, sharding, simhash, spelling, suffixes, tokencount, \
    topk, toxicity
from .frames import table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; every worker has them at the same place."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark, sf_dir):
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op5_html_text(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spelling.groups(spelling.vocabulary(docs))


def op12_document_fingerprints(spark, sf_dir):
    return fingerprints.with_successors(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark, sf_dir):
    return alignment.digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                            tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_token_counts, op3_benchmark_decontamination, op4_suffix_array_dedup,
    op5_html_text, op6_packing, op7_toxicity, op8_exact_top_k, op9_simhash_near_dedup, op10_sharding,
    op11_spelling_variants, op12_document_fingerprints, op13_tokenizer_alignment,
)}

# DuckDB SQL by query name, where SQL can express the operator over whole tables.
SQL: dict[str, str] = {}
