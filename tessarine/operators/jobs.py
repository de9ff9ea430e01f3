"""Set-based changes of the job, run, repository and installation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarine.operators.lineage import LIVE, latest_per

TERMINAL = ("completed", "dead", "superseded", "abandoned", "rejected")


def lease_lost(now: Column) -> Column:
    return F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)


def job_status(jobs: DataFrame, now: Column) -> DataFrame:
    """``jobs`` with ``status``; needs suspended_at and uninstalled_at of the installation."""
    queued, running = F.col("state") == "queued", F.col("state") == "running"
    spent = F.col("attempts") >= F.col("max_attempts")
    status = (
        F.when(spent & (queued | (running & lease_lost(now))), "dead_pending")
        .when(running & lease_lost(now), "stalled")
        .when(running, "running")
        .when(queued & F.col("suspended_at").isNotNull() & F.col("uninstalled_at").isNull(), "deferred_suspended")
        .when(queued & (F.col("attempts") > 0), "retrying")
        .when(queued & (F.col("run_after") > now), "scheduled")
        .when(queued, "queued")
        .otherwise(F.col("state"))
    )
    return jobs.withColumn("status", status)


def claimable_jobs(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The oldest ``n`` jobs with attempts left that are due, or whose lease ran out."""
    due = (F.col("state") == "queued") & (F.col("run_after") <= now)
    lost = (F.col("state") == "running") & lease_lost(now)
    return jobs.filter((F.col("attempts") < F.col("max_attempts")) & (due | lost)).orderBy("run_after", "job_id").limit(n)


def sweep_exhausted(jobs: DataFrame, now: Column) -> DataFrame:
    spent = (F.col("attempts") >= F.col("max_attempts")) & ((F.col("state") == "queued") | ((F.col("state") == "running") & lease_lost(now)))
    return jobs.withColumn("state", F.when(spent, "dead").otherwise(F.col("state")))


def coalesce_requests(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """(repository_id, job_id, state, needs_rerun, action): a live job is flagged to run again, else a new one is queued.

    Requests of one repository count once, so at most one live job per repository stays.
    """
    asked = requests.select("repository_id").distinct().withColumn("asked", F.lit(True))
    live = jobs.filter(F.col("state").isin(*LIVE)).select("repository_id", "job_id", "state", "needs_rerun")
    j = live.join(asked, "repository_id", "full")
    fresh = F.col("job_id").isNull()
    return j.select(
        "repository_id", "job_id", F.coalesce("state", F.lit("queued")).alias("state"), F.when(fresh, False).otherwise(F.col("needs_rerun") | F.coalesce("asked", F.lit(False))).alias("needs_rerun"),
        F.when(fresh, "insert").when(F.col("asked"), "flag").otherwise("keep").alias("action"),
    )


def supersede_live(jobs: DataFrame, repositories: DataFrame) -> DataFrame:
    gone = repositories.select("repository_id").distinct().withColumn("gone", F.lit(True))
    j = jobs.join(gone, "repository_id", "left")
    return j.withColumn("state", F.when(F.col("gone") & F.col("state").isin(*LIVE), "superseded").otherwise(F.col("state"))).drop("gone")


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs after their outcomes, and the follow-up jobs (job_id null) of completed jobs flagged to run again.

    An outcome counts only for a running job that its owner still holds. fail -> queued, or dead when attempts are
    spent; defer -> queued with the attempt handed back; complete, reject, abandon end the job.
    """
    o = outcomes.select("job_id", F.col("owner").alias("by"), "outcome")
    j = jobs.join(o, "job_id", "left")
    holds = (F.col("state") == "running") & (F.col("by") == F.col("lease_owner"))
    is_ = lambda name: holds & (F.col("outcome") == name)
    state = (
        F.when(is_("complete"), "completed").when(is_("reject"), "rejected").when(is_("abandon"), "abandoned").when(is_("defer"), "queued")
        .when(is_("fail"), F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("queued")).otherwise(F.col("state"))
    )
    attempts = F.when(is_("defer"), F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts"))
    done = j.select("job_id", "repository_id", state.alias("state"), attempts.cast("long").alias("attempts"), F.when(holds & F.col("outcome").isNotNull(), F.lit(None)).otherwise(F.col("lease_owner")).alias("lease_owner"), (is_("complete") & F.col("needs_rerun")).alias("again"))
    more = done.filter("again").select(F.lit(None).cast("long").alias("job_id"), "repository_id", F.lit("queued").alias("state"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("lease_owner"))
    return done.drop("again").unionByName(more)


def project_sync_state(repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each repository's sync state from its newest job."""
    best = latest_per(jobs, ["repository_id"], F.desc("updated_at"), F.desc("job_id"))
    state = F.when(F.col("state") == "completed", "synced").when(F.col("state") == "running", "syncing").when(F.col("state") == "queued", "pending").when(F.col("state").isin("dead", "rejected"), "failed").otherwise("never")
    return repositories.join(best.select("repository_id", "state"), "repository_id", "left").select("repository_id", state.alias("sync_state"))


def upsert(known: DataFrame, rows: DataFrame, keys: list[str], mutable: list[str]) -> DataFrame:
    """One row per key: known rows with their mutable columns replaced, and new rows. Null keys match nothing."""
    new = rows.select(*(F.col(k).alias(f"n_{k}") for k in keys), *(F.col(c).alias(f"n_{c}") for c in rows.columns if c not in keys))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"n_{k}") for k in keys])
    j = known.join(new, on, "full")
    fresh = reduce(lambda a, b: a & b, [F.col(f"n_{k}").isNotNull() for k in keys])
    cols = [F.coalesce(k, f"n_{k}").alias(k) for k in keys]
    for c in (c for c in known.columns if c not in keys):
        was_known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        cols.append((F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)) if c in mutable else F.when(was_known, F.col(c)).otherwise(F.col(f"n_{c}"))).alias(c))
    return j.select(*cols)


def prune(df: DataFrame, at: str, now: Column, days: int = 30, only: Column | None = None) -> DataFrame:
    """``df`` without rows older than ``days``, of those that ``only`` holds for."""
    old = F.col(at) < now - F.make_dt_interval(days=F.lit(days))
    return df.filter(~F.coalesce(old if only is None else old & only, F.lit(False)))


def backfill_jobs(repositories: DataFrame, installations: DataFrame, jobs: DataFrame) -> DataFrame:
    """(repository_id, action): a job for each pending or syncing repository that has a live installation and no live job; others of these stand down."""
    live = jobs.filter(F.col("state").isin(*LIVE)).select("repository_id").distinct()
    waiting = repositories.filter(F.col("sync_state").isin("pending", "syncing")).join(live, "repository_id", "left_anti")
    fine = installations.filter("suspended_at is null and uninstalled_at is null").select("installation").withColumn("fine", F.lit(True))
    return waiting.join(fine, "installation", "left").select("repository_id", F.when(F.col("fine"), "enqueue").otherwise("stand_down").alias("action"))


SYMBOL = ["repository_id", "file_path", "symbol_path", "kind", "ordinal"]


def archive_symbols(stored: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """Stored symbols after a run: absent ones get archived_at, returning ones lose it, new ones are added."""
    seen = current.select(*SYMBOL).distinct().withColumn("here", F.lit(True))
    j = stored.withColumn("was", F.lit(True)).join(seen, SYMBOL, "full")
    action = F.when(F.col("was").isNull(), "added").when(F.col("here").isNull() & F.col("archived_at").isNull(), "archived").when(F.col("here") & F.col("archived_at").isNotNull(), "resurrected").otherwise("kept")
    return j.select(*SYMBOL, F.when(F.col("here"), F.lit(None)).otherwise(F.coalesce("archived_at", now)).alias("archived_at"), action.alias("action"))


def progress_fields(jobs: DataFrame, column: str, *fields: str) -> DataFrame:
    """Integer counters out of a JSON column; missing fields and broken JSON are null."""
    parsed = F.from_json(column, "struct<" + ",".join(f"{f}:bigint" for f in fields) + ">")
    return jobs.withColumn("_p", parsed).select(*jobs.columns, *(F.col(f"_p.{f}").alias(f) for f in fields))


def backfill_org(rows: DataFrame, projects: DataFrame) -> DataFrame:
    p = projects.select("project_id", F.col("organization_id").alias("of"))
    return rows.join(p, "project_id", "left").withColumn("organization_id", F.coalesce("organization_id", "of")).drop("of")


def build_discovery_index(installations: DataFrame) -> DataFrame:
    """installation -> organization, the first kept, a re-keyed row replacing it."""
    return latest_per(installations, ["installation"], F.desc("rekeyed"), F.col("created_at"), F.col("organization")).select("installation", "organization")


def upsert_installations(known: DataFrame, rows: DataFrame) -> DataFrame:
    """(installation, organization, status, outcome): replaced only within its organization, else refused."""
    new = rows.select("installation", F.col("organization").alias("no"), F.col("status").alias("ns"))
    j = known.join(new, "installation", "full")
    outcome = F.when(F.col("organization").isNull(), "inserted").when(F.col("no").isNull(), "kept").when(F.col("no") == F.col("organization"), "replaced").otherwise("refused")
    return j.select("installation", F.coalesce("organization", "no").alias("organization"), F.when(outcome.isin("inserted", "replaced"), F.col("ns")).otherwise(F.col("status")).alias("status"), outcome.alias("outcome"))
