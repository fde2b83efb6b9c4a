"""Named queries of the corpus operators, with the SQL that checks them where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetfold.llm import (
    exact_dedup, filter_audit, minhash_join, mixing, packing, phrases, quality_classifier, quality_rules, secrets, simhash,
    suffix_dedup, token_files, toxicity,
)
from fleetfold.llm.common import table


def WORD_TOKENIZER() -> str:
    """The file of the public word tokenizer; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def BYTE_TOKENIZER() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents")).drop("found")


def op2_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("text", "lang", "source", "n_chars")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"), WORD_TOKENIZER())


def op10_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_TOKENIZER())


def op11_phrase_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(spark, f"{sf_dir.rstrip('/')}/documents*.parquet", table(spark, sf_dir, "labels"))


def op13_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_automaton, op2_toxicity_neighbours, op3_source_mix, op4_suffix_dedup, op5_quality_neighbours,
        op6_line_frequency_rules, op7_simhash, op8_chunk_recipes, op9_token_files, op10_concatenate_and_cut,
        op11_phrase_trie, op12_filter_audit, op13_minhash_join,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mix": mixing.SQL,
    "op6_line_frequency_rules": quality_rules.SQL,
    "op8_chunk_recipes": exact_dedup.SQL,
    "op11_phrase_trie": phrases.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
