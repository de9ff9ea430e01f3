"""The cleaning pipeline: quality rules, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessarine.llm._work import free, materialize
from tessarine.llm.mixing import mix_sources
from tessarine.llm.near_dedup import drop_near_duplicates
from tessarine.llm.packing import pack_documents
from tessarine.llm.quality import keep_good
from tessarine.llm.queries import table, tokenizer_path
from tessarine.llm.substring import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; every document stays."""
    return drop_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as their source's share takes them."""
    return mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences, a row for each piece."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("pack", pack)]
#: Hashing, chunking and tokenising can't be said in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again, its predecessor's table deleted then; an empty table passes through all of them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        free(docs)  # a stage's own table; the given one stays
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
