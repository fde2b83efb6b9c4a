"""Corpus pipeline: rules, exact dedup, near dedup, mixing and packing, one stage after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetfold.llm import exact_dedup, mixing, packing, quality_rules, simhash
from fleetfold.llm.common import table
from fleetfold.llm.queries import BYTE_TOKENIZER
from fleetfold.sources.scratch import scratch_dir

#: What goes into training: each document once at most, nine tenths of the tokens.
MIX = mixing.Mix(
    domains={"crawl": 3, "forum": 3, "books": 4}, languages={"en": 6, "de": 2, "fr": 2}, budget_percent=90, max_epochs=1
)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are common in their host."""
    return quality_rules.clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: 4-word shingles, links at 4 or fewer differing bits."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take."""
    return mixing.mixed_documents(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.packed(docs, BYTE_TOKENIZER())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack),
]

#: Fingerprints, components and tokens are not SQL; the tests check run() by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
