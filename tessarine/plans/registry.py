"""All registered queries outside the llm subpackage, by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessarine.plans import chunk_queries, evaluation_queries, lineage_queries, retrieval_queries, source_queries, streaming_queries, text_queries

FAMILIES = (text_queries, chunk_queries, retrieval_queries, lineage_queries, evaluation_queries, streaming_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.R.sql.items()}
