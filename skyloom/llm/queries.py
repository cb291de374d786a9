"""The operators' queries over the driver's tables (opN_<name>) and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.language_id import fit_and_identify

    return fit_and_identify(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.substring_dedup import remove_repeated_windows

    return remove_repeated_windows(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.licenses import find_licenses

    return find_licenses(_table(spark, sf_dir, "documents"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.imatch import compare_with_edits

    return compare_with_edits(_table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.suffix_dedup import PASSAGE, remove_repeated_strings

    return remove_repeated_strings(_table(spark, sf_dir, "documents"), passage=PASSAGE)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skyloom.llm.byte_bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skyloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from skyloom.llm.sql import ORACLES

    return dict(ORACLES)
