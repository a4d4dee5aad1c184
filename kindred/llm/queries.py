"""The queries opN_<name> of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.oracles import ORACLES
from kindred.sources.tables import spread

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.quality import with_quality

    return with_quality(_read(spark, d, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "lost_chars")


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.mixing import mix

    return mix(_read(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.warc import round_trip

    return round_trip(_read(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.substring import remove_repeats

    return remove_repeats(_read(spark, d, "documents"))


def op4_ann(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.ann import nearest

    return nearest(_read(spark, d, "embeddings"))


def op5_html_text(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.htmltext import extract

    return extract(_read(spark, d, "pages"))


def op6_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.secret_scan import find_secrets

    return find_secrets(_read(spark, d, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.bpe import tokenize

    return tokenize(_read(spark, d, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, d, "documents"))


def op9_chat(spark: SparkSession, d: str) -> DataFrame:
    from kindred.llm.chat import format_turns

    return format_turns(_read(spark, d, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ann": op4_ann,
    "op5_html_text": op5_html_text,
    "op6_secret_scan": op6_secret_scan,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_mixing": op10_mixing,
}

