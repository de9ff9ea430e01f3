"""Retrieval, lineage and evaluation analytics as Spark DataFrame operators."""
