"""Stored postings: partitions by tenant bucket, buckets by repository and term, read for the asked tenants only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.operators.lineage import TENANT_BUCKETS, tenant_bucket
from tessarine.operators.retrieval import LEG_LIMIT, build_postings, keyword_leg, query_terms

BUCKETS = 64


class PostingsStore:
    """A Parquet table of ``build_postings`` at ``path``, partitioned by ``org_bucket`` and bucketed and sorted by (repository, term).

    The catalog entry is named after the path and made again by any session that opens it. ``buckets`` belongs to the
    stored files: open with the number it was written with. Where the queries' terms are too many to be broadcast,
    they are shuffled to the buckets, and postings stay where they are.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "postings_" + hashlib.sha256(path.encode()).hexdigest()[:16]

    def write(self, chunks: DataFrame, key: str = "chunk_id") -> None:
        """Index whole chunks; what stood at the path goes. A null tenant or repository is in nobody's reach and is left out."""
        own = chunks.filter("organization IS NOT NULL AND repository IS NOT NULL")
        rows = build_postings(own, key).withColumn("org_bucket", tenant_bucket(F.col("organization"))).repartition(self.buckets, "repository", "term")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        rows.write.format("parquet").mode("overwrite").option("path", self.path).partitionBy("org_bucket").bucketBy(self.buckets, "repository", "term").sortBy("repository", "term").saveAsTable(self.name)

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self.path).schema)
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY (org_bucket) CLUSTERED BY (repository, term) SORTED BY (repository, term) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        return self.spark.table(self.name)

    def asked(self, queries: DataFrame) -> DataFrame:
        """Postings of the queries' terms in their own repositories. Buckets of tenants that don't ask are not opened.

        The asked buckets, TENANT_BUCKETS numbers at most, become literals; terms are a semi-join, which Spark sends ahead
        of the scan as a broadcast or as a Bloom filter.
        """
        wanted = query_terms(queries).select("organization", "repository", "term").distinct()
        buckets = sorted(r[0] for r in queries.filter("organization IS NOT NULL").select(tenant_bucket(F.col("organization"))).distinct().limit(TENANT_BUCKETS).collect())
        rows = self.read().filter(F.col("org_bucket").isin(*buckets)) if buckets else self.read().limit(0)
        return rows.join(wanted, ["organization", "repository", "term"], "left_semi")

    def keyword_leg(self, queries: DataFrame, limit: int = LEG_LIMIT, key: str = "chunk_id") -> DataFrame:
        return keyword_leg(None, queries, limit, key, postings=self.asked(queries))
