"""Registered queries of the corpus operators: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokscope.llm.common import default_parallelism, documents, read_table, scratch_path
from tokscope.llm.decontaminate import find_leaks
from tokscope.llm.hard_negatives import mine_hard_negatives
from tokscope.llm.html_extract import extract
from tokscope.llm.lang_id import identify_languages
from tokscope.llm.lexical_search import search
from tokscope.llm.line_dedup import dedup_lines
from tokscope.llm.ngram_join import ngram_components
from tokscope.llm.oracle import ORACLE_SQL
from tokscope.llm.packing import pack_documents
from tokscope.llm.quality_lm import classify
from tokscope.llm.quality_rules import quality_rules
from tokscope.llm.suffix_dedup import remove_repeats
from tokscope.llm.token_files import read_tokens, token_digests, write_tokens
from tokscope.llm.url_filter import filter_urls

__all__ = ["ORACLE_SQL", "QUERIES"]


def _few_files(df: DataFrame) -> DataFrame:
    """Results that end in a shuffle: their rows are small, one file per core holds them."""
    return df.coalesce(default_parallelism(df.sparkSession))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_chars=40, min_docs=5)
    return _few_files(kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")).drop("mined")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few_files(ngram_components(documents(spark, sf_dir), width=4, percent=85))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op5_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"), keep=["doc_id"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few_files(pack_documents(documents(spark, sf_dir), max_tokens=1024))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few_files(remove_repeats(documents(spark, sf_dir), min_length=100, with_kept=False))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "similarity", "word_start", "n_words", "distance")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), path)
    return token_digests(read_tokens(spark, path))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), k=10)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine_hard_negatives(rows, F.col("id") % 100 == 0, scale=256, positives=5, negatives=5, low_percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_ngram_join": op3_ngram_join,
    "op4_html_extract": op4_html_extract,
    "op5_quality_lm": op5_quality_lm,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_token_files": op11_token_files,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}
