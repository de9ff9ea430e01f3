"""Tenancy scopes, provenance joins, lookups and feedback aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TENANT_BUCKETS = 64


def tenant_bucket(org: Column) -> Column:
    """The partition column of a tenant, the same for ids of any type; a literal tenant gives a literal bucket, which prunes partitions."""
    return F.pmod(F.xxhash64(org.cast("string")), F.lit(TENANT_BUCKETS)).cast("int")


def tenant_scope(df: DataFrame, organization: int | str, column: str = "organization_id") -> DataFrame:
    """Rows of one organization. A null or blank tenant is refused."""
    if organization is None or not str(organization).strip():
        raise ValueError("a tenant must be named")
    own = F.lit(str(organization)).cast(df.schema[column].dataType)
    out = df.filter(F.col(column) == own)
    return out.filter(F.col("org_bucket") == tenant_bucket(own)) if "org_bucket" in df.columns else out


def scope_via_chain(df: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Semi joins up a chain of parents: each step is (parent, key in child, key in parent), outermost parent last.

    The outermost parent is already scoped; every table below keeps only rows that reach it.
    """
    (parent, child_key, parent_key), *rest = steps
    over = scope_via_chain(parent, *rest) if rest else parent
    return df.join(over.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def trace_chunk_to_commit(chunks: DataFrame, runs: DataFrame, repositories: DataFrame) -> DataFrame:
    return chunks.join(runs, "run_id").join(repositories, "repository_id")


def chunks_of_commit(chunks: DataFrame, runs: DataFrame, wanted: Column) -> DataFrame:
    return chunks.join(runs.filter(wanted).select("run_id"), "run_id", "left_semi")


def run_summary(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Declared and actual chunks of every run; runs without chunks have 0."""
    actual = chunks.groupBy("run_id").agg(F.count(F.lit(1)).alias("actual"))
    return runs.join(actual, "run_id", "left").na.fill(0, ["actual"])


def query_results_with_feedback(retrievals: DataFrame, feedback: DataFrame) -> DataFrame:
    j = retrievals.join(feedback.select("retrieval_id", "feedback_type"), "retrieval_id", "left")
    return j.withColumn("feedback_type", F.coalesce("feedback_type", F.lit("no_feedback")))


def feedback_lineage(feedback: DataFrame, retrievals: DataFrame, chunks: DataFrame, runs: DataFrame, repositories: DataFrame, projects: DataFrame, organizations: DataFrame) -> DataFrame:
    """Every feedback with the chunk it judged and all that holds it, up to the organization; a broken chain drops its row.

    Keys are named alike on both sides: retrieval_id, chunk_id, run_id, repository_id, project_id, organization_id.
    """
    out = feedback.join(retrievals.select("retrieval_id", "chunk_id"), "retrieval_id").join(chunks.select("chunk_id", "run_id"), "chunk_id")
    for over, key in ((runs, "run_id"), (repositories, "repository_id"), (projects, "project_id"), (organizations, "organization_id")):
        out = out.join(over, key)
    return out


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


LIVE = ("queued", "running")


def current_job(repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each repository with its live job, else the newest by (created_at, job_id); null where it has none."""
    best = latest_per(jobs, ["repository_id"], F.col("state").isin(*LIVE).desc(), F.desc("created_at"), F.desc("job_id"))
    return repositories.join(best.select("repository_id", "job_id", "state"), "repository_id", "left")


def repositories_page(repositories: DataFrame, jobs: DataFrame, after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` repositories by (created_at, repository_id) past ``after``, newest first, with their job."""
    rows = repositories
    if after is not None:
        at, key = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rows = rows.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("repository_id") < key)))
    page = rows.orderBy(F.desc("created_at"), F.desc("repository_id")).limit(limit)
    return current_job(page, jobs)


def first_known(asked: DataFrame, ask: str, ways: list[tuple[Column, DataFrame, Column]], order: list[str]) -> DataFrame:
    """(ask, the last of ``order``): of the known rows that match an asked one, the first by way, then by ``order``.

    A way is (key of the asked rows, known rows, their key). Only the first known row of a key can win, so each key
    keeps that one before it is joined, and an asked row meets at most one row in each way, however many share its key.
    """
    out, found = asked, []
    for i, (own, known, key) in enumerate(ways):
        best = known.select(key.alias(f"_k{i}"), *order).filter(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(F.min(F.struct(*order)).alias(f"_b{i}"))
        out = out.withColumn(f"_a{i}", own).join(best, F.col(f"_a{i}") == F.col(f"_k{i}"), "left")
        found.append(F.when(F.col(f"_b{i}").isNotNull(), F.struct(F.lit(i).alias("way"), f"_b{i}.*")))
    met = out.select(ask, F.coalesce(*found).alias("_first")).filter("_first is not null")
    return met.groupBy(ask).agg(F.min("_first").alias("_first")).select(ask, f"_first.{order[-1]}")


def find_existing(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(ask_id, repository_id): by outer id, or by URL where the known row has none; an id match first, then the oldest."""
    ways = [(F.col("outer_id"), known, F.col("outer_id")), (F.col("url"), known.filter("outer_id is null"), F.col("url"))]
    return first_known(asked, "ask_id", ways, ["created_at", "repository_id"])


def resolve_installation(events: DataFrame, index: DataFrame) -> DataFrame:
    """Events with their organization; unknown installations are kept as ignored."""
    j = events.join(index, "installation", "left")
    return j.withColumn("outcome", F.when(F.col("organization").isNull(), "ignored").otherwise("resolved"))


def user_organizations(memberships: DataFrame, organizations: DataFrame) -> DataFrame:
    return memberships.join(organizations, "organization_id").orderBy("user_id", "name", "organization_id")


def owner_assignment(memberships: DataFrame) -> DataFrame:
    """Each user's first organization as owner, by membership date, then id."""
    return latest_per(memberships.filter("role = 'owner'"), ["user_id"], F.col("joined_at"), F.col("organization_id"))


def cascade_counts(repositories: DataFrame, runs: DataFrame, chunks: DataFrame, feedback: DataFrame) -> DataFrame:
    """What deleting each repository removes: runs, chunks and feedback, zeros kept."""
    out = repositories.select("repository_id")
    for name, df in (("runs", runs), ("chunks", chunks), ("feedback", feedback)):
        out = out.join(df.groupBy("repository_id").agg(F.count(F.lit(1)).alias(name)), "repository_id", "left")
    return out.na.fill(0)


def dangling_retrievals(retrievals: DataFrame, chunks: DataFrame) -> DataFrame:
    return retrievals.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def installation_of_job(jobs: DataFrame, installations: DataFrame) -> DataFrame:
    """run, defer (suspended) or abandon (uninstalled, or no installation)."""
    j = jobs.join(installations, "installation", "left")
    verdict = F.when(F.col("organization").isNull() | F.col("uninstalled_at").isNotNull(), "abandon").when(F.col("suspended_at").isNotNull(), "defer").otherwise("run")
    return j.withColumn("verdict", verdict)


def list_installations(installations: DataFrame, organization: int | str) -> DataFrame:
    """One organization's installations, oldest first."""
    return tenant_scope(installations, organization).orderBy("created_at", "installation_id")


def resolve_user(logins: DataFrame, users: DataFrame) -> DataFrame:
    """(login_id, user_id): by identity or by lower-cased email, identity first."""
    ways = [(F.col("identity"), users, F.col("identity")), (F.lower("email"), users, F.lower("email"))]
    return first_known(logins, "login_id", ways, ["user_id"])


def feedback_breakdown(feedback: DataFrame) -> DataFrame:
    g = feedback.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def chunk_performance(retrievals: DataFrame, least: int = 1) -> DataFrame:
    """Per chunk: distinct retrievals, positive and negative feedback, and percent positive of what was judged."""
    g = retrievals.groupBy("chunk_id").agg(F.count_distinct("retrieval_id").alias("retrieved"), F.count_if(F.col("feedback_type") == "positive").alias("positive"), F.count_if(F.col("feedback_type") == "negative").alias("negative"))
    judged = F.col("positive") + F.col("negative")
    return g.filter(F.col("retrieved") >= least).withColumn("percent", F.round(F.try_divide(100.0 * F.col("positive"), judged), 2)).orderBy(F.desc_nulls_last("percent"), "chunk_id")


def chunk_inventory(chunks: DataFrame, *by: str) -> DataFrame:
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def rows_per_model(chunks: DataFrame) -> DataFrame:
    """Chunks of each repository by embedding model; chunks without a vector count under a null model."""
    return chunk_inventory(chunks, "repository_id", "embedding_model")


def timestamp_completeness(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNotNull()).alias(f"with_{c}") for c in columns))


def default_project(projects: DataFrame) -> DataFrame:
    """Of each organization without a flagged project, the oldest."""
    flagged = projects.filter("is_default").select("organization_id").distinct()
    return latest_per(projects.join(flagged, "organization_id", "left_anti"), ["organization_id"], F.col("created_at"), F.col("project_id"))


def indexed_state(repositories: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    out = repositories.select("repository_id")
    for name, df in (("runs", runs), ("chunks", chunks)):
        out = out.join(df.groupBy("repository_id").agg(F.count(F.lit(1)).alias(name)), "repository_id", "left")
    return out.na.fill(0)
