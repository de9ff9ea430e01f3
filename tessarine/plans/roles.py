"""The given tables in the roles of the operators' inputs, as DataFrames and, for the checks, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRS = ("src", "vendor", "node_modules", "docs", ".aws", "lib", "pkg")
NAMES = (
    "main.py", "user_service.go", "test_api.ts", "route_map.tsx", "README.md", "app.min.js", "yarn.lock", "server.pem", "credentials", "id_rsa_old",
    "model_pb2.py", "config.yaml", "util.js",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def pick_sql(key: str, values: tuple) -> str:
    return f"({list(values)!r})[({key}) % {len(values)} + 1]"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = pick(F.col("doc_id"), NAMES)
    org = (F.substring("source", 4, 9).cast("long") % 4).alias("organization")
    path = F.concat_ws("/", "source", pick(F.col("doc_id"), DIRS), F.col("doc_id").cast("string"), name)
    return d.select("doc_id", F.col("text").alias("content"), F.col("source").alias("repository"), org, path.alias("path"), name.alias("name"), "lang", "n_chars")


FILES = (
    f"SELECT doc_id, text AS content, source AS repository, CAST(substr(source, 4) AS BIGINT) % 4 AS organization, "
    f"source || '/' || {pick_sql('doc_id', DIRS)} || '/' || doc_id || '/' || {pick_sql('doc_id', NAMES)} AS path, {pick_sql('doc_id', NAMES)} AS name, lang, n_chars FROM documents"
)


SOURCES, RUN = 20, 3


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword queries: the whole of every benchmark text, in runs of three words, each asked in one repository of its organization."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    runs = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.size(words) / RUN).cast("int") - 1), lambda g: F.slice(words, g * RUN + 1, RUN))).alias("g", "own"))
    source = (F.col("item_id") + F.col("g")) % SOURCES
    return runs.select((F.col("item_id") * 10000 + F.col("g")).alias("query_id"), (source % 4).alias("organization"), F.concat(F.lit("src"), source.cast("string")).alias("repository"), F.array_join("own", " ").alias("query"))


QUESTIONS = f"""SELECT item_id * 10000 + g AS query_id, (item_id + g) % {SOURCES} % 4 AS organization, 'src' || ((item_id + g) % {SOURCES}) AS repository, array_to_string(w[g * {RUN} + 1:g * {RUN} + {RUN}], ' ') AS query
  FROM (SELECT item_id, w, unnest(range(0, CAST(ceil(len(w) / {RUN}e0) AS BIGINT))) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark))"""


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    repository = F.col("label").cast("long")
    return e.select(F.col("vec_id").alias("chunk_id"), (repository % 4).alias("organization"), repository.alias("repository"), (F.col("vec_id") % 2).alias("model"), "embedding")


VECTOR_CHUNKS = "SELECT vec_id AS chunk_id, CAST(label AS BIGINT) % 4 AS organization, CAST(label AS BIGINT) AS repository, vec_id % 2 AS model, embedding FROM embeddings"


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as those of the documents of the same number, in their repositories, of one model."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(0).alias("model"), "embedding")
    return files(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "organization", "repository").join(e, "chunk_id")


DOCUMENT_VECTORS = f"SELECT doc_id AS chunk_id, organization, repository, embedding FROM ({FILES}) JOIN embeddings ON vec_id = doc_id"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ingestion jobs; ``seq`` numbers a repository's jobs by key."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("repository_id"), state.alias("state"), (F.col("o_orderkey") % 6).alias("attempts"), F.lit(5).cast("long").alias("max_attempts"),
        at.alias("run_after"), at.alias("created_at"), at.alias("updated_at"),
        F.when(F.col("o_orderstatus") == "P", F.timestamp_add("DAY", F.lit(30), at)).alias("lease_expires_at"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("w"), (F.col("o_orderkey") % 7).cast("string"))).alias("lease_owner"),
        (F.col("o_orderkey") % 3 == 0).alias("needs_rerun"),
    )


JOBS = (
    "SELECT o_orderkey AS job_id, o_custkey AS repository_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS state, "
    "o_orderkey % 6 AS attempts, CAST(5 AS BIGINT) AS max_attempts, o_orderdate AS run_after, o_orderdate AS created_at, o_orderdate AS updated_at, "
    "CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 30 DAY END AS lease_expires_at, CASE WHEN o_orderstatus = 'P' THEN 'w' || (o_orderkey % 7) END AS lease_owner, "
    "o_orderkey % 3 = 0 AS needs_rerun FROM orders"
)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("delivery_id"), F.col("event_type").alias("event"), F.col("user_id").alias("installation"), F.col("ts").cast("timestamp").alias("received_at"), "value", "props")


DELIVERIES = "SELECT event_id AS delivery_id, event_type AS event, user_id AS installation, ts AS received_at, value, props FROM events"


class Registry:
    """Named queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.sql[name] = sql
