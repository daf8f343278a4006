"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.alignment import align_tokens
from ledgerline.llm.decontaminate import find_benchmark
from ledgerline.llm.licences import scan_licences, scan_sql
from ledgerline.llm.line_rules import quality_rules
from ledgerline.llm.line_templates import drop_recurring_lines
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.pages import extract_text
from ledgerline.llm.partenum import near_duplicates
from ledgerline.llm.prefix_trie import prefix_trie, trie_sql
from ledgerline.llm.quality import score_quality
from ledgerline.llm.registry import query, table
from ledgerline.llm.secret_scan import scan_secrets
from ledgerline.llm.token_counts import token_counts
from ledgerline.llm.toxicity import score_toxicity


@query("op1_page_differencing")
def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query("op2_partenum_join")
def op2_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_positive_unlabelled_quality")
def op3_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_noisy_or_toxicity")
def op4_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_line_frequency")
def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op6_line_templates")
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_words_dropped")


@query("op7_template_decontamination")
def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op9_license_scan", scan_sql())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op12_merge_path_alignment")
def op12_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_tokens(table(spark, sf_dir, "documents"), *paths)


@query("op13_prefix_trie", trie_sql())
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
