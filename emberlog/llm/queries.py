"""The queries of the thirteen operators and of the corpus pipeline: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import exact_dedup, license_scan, ngram_join, prefix_trie, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, source_mix, suffix_dedup, token_alignment, token_counts, url_filters
from emberlog.llm.common import tokenizer_path
from emberlog.llm.oracles import ORACLES
from emberlog.session import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Path(tokenizer_path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"), best=True)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.judged(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.sentencepiece(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", "n_bytes_fallback", F.xxhash64("ids").alias("ids_hash"), "exact")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = Path(tokenizer_path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    second = Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()
    return token_alignment.token_alignment(table(spark, sf_dir, "documents"), first, second)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_exact_dedup, op2_url_filters, op3_token_counts, op4_license_scan, op5_secret_scan, op6_source_mix, op7_ngram_join,
        op8_quality_rules, op9_sentencepiece, op10_quality_classifier, op11_token_alignment, op12_prefix_trie, op13_suffix_dedup, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
