"""Registered queries of tenancy, lineage, jobs and quality checks, over the chain region - nation - customer - orders - lineitem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.operators import jobs as a
from tessarine.operators import lineage as j
from tessarine.operators import quality as v
from tessarine.plans.roles import JOBS, Registry, jobs, table
from tessarine.sources.files import replace_repository_chunks
from tessarine.streaming.run import scratch

R = Registry()
NOW, NOW_SQL = "1996-06-01 00:00:00", "TIMESTAMP '1996-06-01 00:00:00'"
col = F.col


def now():
    return F.lit(NOW).cast("timestamp")


def orgs(s, d):
    return table(s, d, "region").select(col("r_regionkey").alias("organization_id"), col("r_name").alias("name"))


def projects(s, d):
    return table(s, d, "nation").select(col("n_nationkey").alias("project_id"), col("n_regionkey").alias("organization_id"), col("n_name").alias("slug"), (col("n_nationkey") % 11 == 0).alias("is_default"), col("n_nationkey").alias("created_at"))


def repositories(s, d):
    return table(s, d, "customer").select(col("c_custkey").alias("repository_id"), col("c_nationkey").alias("project_id"), col("c_name").alias("name"), F.date_add(F.lit("2020-01-01").cast("date"), (col("c_custkey") % 300).cast("int")).cast("timestamp").alias("created_at"))


def runs(s, d):
    return table(s, d, "orders").select(col("o_orderkey").alias("run_id"), col("o_custkey").alias("repository_id"), col("o_orderstatus").alias("status"), (col("o_orderkey") % 5).alias("declared"))


def chunks(s, d):
    return table(s, d, "lineitem").select((col("l_orderkey") * 10 + col("l_linenumber")).alias("chunk_id"), col("l_orderkey").alias("run_id"), col("l_partkey").alias("symbol_id"), "l_returnflag", "l_shipdate")


def feedback(s, d):
    return table(s, d, "labels").select(col("doc_id").alias("retrieval_id"), F.when(col("quality") == 1, "positive").otherwise("negative").alias("feedback_type"))


def retrievals(s, d):
    return table(s, d, "documents").select(col("doc_id").alias("retrieval_id"), (col("doc_id") % 40).alias("chunk_id"), col("source").alias("query"))




def _bucketed(s, d):
    """Repositories written in tenant buckets, read back one tenant at a time."""
    path = scratch(s, "tenants")
    replace_repository_chunks(repositories(s, d).select(col("project_id").alias("organization_id"), (col("repository_id") % 40).alias("repository_id"), "name"), path)
    kept = s.read.parquet(path)
    return reduce(DataFrame.unionByName, [j.tenant_scope(kept, t) for t in range(25)]).select("organization_id", "name")


R.add("p14_tenant_buckets", _bucketed, "SELECT c_nationkey AS organization_id, c_name AS name FROM customer")
R.add("p14_tenant_scope", lambda s, d: j.tenant_scope(projects(s, d), 2).select("project_id", "slug"), "SELECT n_nationkey AS project_id, n_name AS slug FROM nation WHERE n_regionkey = 2")
R.add(
    "p15_scope_via_chain",
    lambda s, d: j.scope_via_chain(chunks(s, d), (runs(s, d), "run_id", "run_id"), (repositories(s, d), "repository_id", "repository_id"), (j.tenant_scope(projects(s, d), 1), "project_id", "project_id")).select("chunk_id", "run_id"),
    "SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS run_id FROM lineitem WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = l_orderkey AND n_regionkey = 1)",
)
R.add("j1_trace_chunk_to_commit", lambda s, d: j.trace_chunk_to_commit(chunks(s, d), runs(s, d), repositories(s, d)).select("chunk_id", "run_id", "repository_id", "status", "name"),
      "SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS run_id, c_custkey AS repository_id, o_orderstatus AS status, c_name AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
R.add("j2_chunks_of_commit", lambda s, d: j.chunks_of_commit(chunks(s, d), runs(s, d), col("status") == "P").select("chunk_id"), "SELECT l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
R.add("j3_run_summary", lambda s, d: j.run_summary(runs(s, d), chunks(s, d)).select("run_id", "declared", "actual"), "SELECT o_orderkey AS run_id, o_orderkey % 5 AS declared, count(l_orderkey) AS actual FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")


def _feedback_lineage(s, d):
    judged = chunks(s, d).select((col("chunk_id") % 500).alias("retrieval_id"), "chunk_id").distinct()
    own = projects(s, d).select("project_id", "organization_id", "slug")
    met = j.feedback_lineage(feedback(s, d), judged, chunks(s, d), runs(s, d), repositories(s, d).select("repository_id", "project_id"), own, orgs(s, d).withColumnRenamed("name", "org"))
    return met.groupBy("org", "slug", "feedback_type").agg(F.count(F.lit(1)).alias("n"))


R.add(
    "j4_feedback_lineage",
    _feedback_lineage,
    """SELECT r_name AS org, n_name AS slug, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS feedback_type, count(*) AS n FROM labels JOIN lineitem ON (l_orderkey * 10 + l_linenumber) % 500 = doc_id
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""",
)
_FB = "SELECT d.doc_id AS retrieval_id, d.doc_id % 40 AS chunk_id, d.source AS query, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'no_feedback' END AS feedback_type FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
R.add("j5_results_with_feedback", lambda s, d: j.query_results_with_feedback(retrievals(s, d), feedback(s, d)), _FB)
_BEST = f"SELECT * FROM ({JOBS}) QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY state IN ('queued', 'running') DESC, created_at DESC, job_id DESC) = 1"
R.add("j6_current_job", lambda s, d: j.current_job(repositories(s, d).select("repository_id"), jobs(s, d)), f"SELECT c_custkey AS repository_id, job_id, state FROM customer LEFT JOIN ({_BEST}) ON repository_id = c_custkey")
R.add(
    "j7_repositories_page",
    lambda s, d: j.repositories_page(repositories(s, d), jobs(s, d), ("2020-06-01", 50), 25).select("repository_id", "job_id", "state"),
    f"WITH p AS (SELECT c_custkey AS repository_id, DATE '2020-01-01' + CAST(c_custkey % 300 AS INTEGER) AS at FROM customer), q AS (SELECT * FROM p WHERE (at, repository_id) < (DATE '2020-06-01', 50) ORDER BY at DESC, repository_id DESC LIMIT 25) SELECT q.repository_id, job_id, state FROM q LEFT JOIN ({_BEST}) b ON b.repository_id = q.repository_id".replace(" at,", " dt,").replace("AS at ", "AS dt ").replace("(at,", "(dt,").replace("BY at ", "BY dt "),
)
R.add(
    "j8_find_existing",
    lambda s, d: j.find_existing(
        table(s, d, "orders").select(col("o_orderkey").alias("ask_id"), (col("o_orderkey") % 400).alias("outer_id"), F.concat(F.lit("u"), (col("o_custkey") % 60).cast("string")).alias("url")),
        table(s, d, "customer").select(col("c_custkey").alias("repository_id"), F.when(col("c_custkey") % 3 == 0, col("c_custkey")).alias("outer_id"), F.concat(F.lit("u"), (col("c_custkey") % 90).cast("string")).alias("url"), (col("c_custkey") % 17).alias("created_at")),
    ),
    """WITH k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS o, 'u' || (c_custkey % 90) AS u, c_custkey % 17 AS c FROM customer),
    m AS (SELECT o_orderkey AS ask_id, id, CASE WHEN o = o_orderkey % 400 THEN 0 ELSE 1 END AS way, c FROM orders JOIN k ON o = o_orderkey % 400 OR (o IS NULL AND u = 'u' || (o_custkey % 60)))
    SELECT ask_id, id AS repository_id FROM m QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY way, c, id) = 1""",
)
_INST = "SELECT c_custkey AS installation, c_nationkey AS organization FROM customer WHERE c_custkey % 2 = 0"


def _installations(s, d):
    return table(s, d, "customer").filter("c_custkey % 2 = 0").select(col("c_custkey").alias("installation"), col("c_nationkey").alias("organization"))


R.add("j9_resolve_installation", lambda s, d: j.resolve_installation(table(s, d, "events").select("event_id", col("user_id").alias("installation")), _installations(s, d)),
      f"SELECT event_id, user_id AS installation, organization, CASE WHEN organization IS NULL THEN 'ignored' ELSE 'resolved' END AS outcome FROM events LEFT JOIN ({_INST}) ON installation = user_id")


def _members(s, d):
    return table(s, d, "orders").select(col("o_custkey").alias("user_id"), (col("o_orderkey") % 5).cast("int").alias("organization_id"), F.when(col("o_orderstatus") == "O", "owner").otherwise("member").alias("role"), col("o_orderdate").alias("joined_at"))


R.add("j10_user_organizations", lambda s, d: j.user_organizations(_members(s, d).select("user_id", "organization_id", "role").distinct(), orgs(s, d)), "SELECT DISTINCT o_custkey AS user_id, CAST(o_orderkey % 5 AS INTEGER) AS organization_id, CASE o_orderstatus WHEN 'O' THEN 'owner' ELSE 'member' END AS role, r_name AS name FROM orders JOIN region ON r_regionkey = o_orderkey % 5")
R.add("j11_owner_assignment", lambda s, d: j.owner_assignment(_members(s, d)).select("user_id", "organization_id"), "SELECT o_custkey AS user_id, CAST(o_orderkey % 5 AS INTEGER) AS organization_id FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey % 5) = 1")
R.add(
    "j12_cascade_counts",
    lambda s, d: j.cascade_counts(repositories(s, d), runs(s, d), chunks(s, d).join(runs(s, d).select("run_id", "repository_id"), "run_id"), feedback(s, d).withColumn("repository_id", col("retrieval_id") % 100)),
    """SELECT c_custkey AS repository_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS runs, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey) AS chunks,
    (SELECT count(*) FROM labels WHERE doc_id % 100 = c_custkey) AS feedback FROM customer""",
)
R.add("j13_dangling_retrievals", lambda s, d: j.dangling_retrievals(table(s, d, "events").select("event_id", (col("event_id") % 2000).alias("chunk_id")), table(s, d, "part").select((col("p_partkey") * 3).alias("chunk_id"))), "SELECT event_id, event_id % 2000 AS chunk_id FROM events WHERE event_id % 2000 NOT IN (SELECT p_partkey * 3 FROM part)")


def _states(s, d):
    return table(s, d, "customer").filter("c_custkey % 7 <> 0").select(col("c_custkey").alias("installation"), col("c_nationkey").alias("organization"), F.when(col("c_custkey") % 3 == 0, "2020-01-01").cast("timestamp").alias("suspended_at"), F.when(col("c_custkey") % 5 == 0, "2020-01-01").cast("timestamp").alias("uninstalled_at"))


R.add("j14_installation_of_job", lambda s, d: j.installation_of_job(jobs(s, d).select("job_id", col("repository_id").alias("installation")), _states(s, d)).select("job_id", "verdict"),
      "SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 7 = 0 OR c_custkey IS NULL OR o_custkey % 5 = 0 THEN 'abandon' WHEN o_custkey % 3 = 0 THEN 'defer' ELSE 'run' END AS verdict FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
R.add(
    "j15_resolve_user",
    lambda s, d: j.resolve_user(table(s, d, "orders").select(col("o_orderkey").alias("login_id"), (col("o_orderkey") % 500).alias("identity"), F.concat(F.lit("U"), (col("o_custkey") % 80).cast("string"), F.lit("@X.org")).alias("email")), table(s, d, "customer").select(col("c_custkey").alias("user_id"), F.when(col("c_custkey") % 2 == 0, col("c_custkey")).alias("identity"), F.concat(F.lit("u"), (col("c_custkey") % 120).cast("string"), F.lit("@x.org")).alias("email"))),
    """WITH u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS i, 'u' || (c_custkey % 120) || '@x.org' AS e FROM customer),
    m AS (SELECT o_orderkey AS login_id, user_id, CASE WHEN i = o_orderkey % 500 THEN 0 ELSE 1 END AS way FROM orders JOIN u ON i = o_orderkey % 500 OR e = lower('U' || (o_custkey % 80) || '@X.org'))
    SELECT login_id, user_id FROM m QUALIFY row_number() OVER (PARTITION BY login_id ORDER BY way, user_id) = 1""",
)
R.add(
    "j16_list_installations",
    lambda s, d: j.list_installations(repositories(s, d).select(col("repository_id").alias("installation_id"), col("project_id").alias("organization_id"), "name", col("repository_id").alias("created_at")), 3).drop("created_at"),
    "SELECT c_custkey AS installation_id, c_nationkey AS organization_id, c_name AS name FROM customer WHERE c_nationkey = 3",
)
R.add("g1_feedback_breakdown", lambda s, d: j.feedback_breakdown(j.query_results_with_feedback(retrievals(s, d), feedback(s, d))), f"SELECT feedback_type, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM ({_FB}) GROUP BY 1")
R.add("g2_chunk_performance", lambda s, d: j.chunk_performance(j.query_results_with_feedback(retrievals(s, d), feedback(s, d)), 3),
      f"""SELECT chunk_id, count(DISTINCT retrieval_id) AS retrieved, count(*) FILTER (WHERE feedback_type = 'positive') AS positive, count(*) FILTER (WHERE feedback_type = 'negative') AS negative,
      round(100e0 * count(*) FILTER (WHERE feedback_type = 'positive') / nullif(count(*) FILTER (WHERE feedback_type <> 'no_feedback'), 0), 2) AS percent FROM ({_FB}) GROUP BY 1 HAVING count(DISTINCT retrieval_id) >= 3""")  # fmt: skip
R.add("g3_chunk_inventory", lambda s, d: j.chunk_inventory(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
R.add(
    "g4_rows_per_model",
    lambda s, d: j.rows_per_model(table(s, d, "embeddings").select(col("label").alias("repository_id"), (col("vec_id") % 2).alias("embedding_model"))),
    "SELECT label AS repository_id, vec_id % 2 AS embedding_model, count(*) AS n FROM embeddings GROUP BY ALL",
)
R.add("g5_timestamp_completeness", lambda s, d: j.timestamp_completeness(jobs(s, d), "lease_expires_at", "run_after"), f"SELECT count(*) AS n, count(lease_expires_at) AS with_lease_expires_at, count(run_after) AS with_run_after FROM ({JOBS})")
R.add("g6_default_project", lambda s, d: j.default_project(projects(s, d)).select("organization_id", "project_id"), "SELECT n_regionkey AS organization_id, n_nationkey AS project_id FROM nation WHERE n_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 11 = 0) QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1")
R.add("g7_indexed_state", lambda s, d: j.indexed_state(repositories(s, d), runs(s, d), chunks(s, d).join(runs(s, d).select("run_id", "repository_id"), "run_id")), "SELECT c_custkey AS repository_id, count(DISTINCT o_orderkey) AS runs, count(l_orderkey) AS chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")

_LOST = f"(lease_expires_at IS NULL OR lease_expires_at < {NOW_SQL})"
_DEAD = f"attempts >= max_attempts AND (state = 'queued' OR (state = 'running' AND {_LOST}))"


def _with_installation(s, d):
    return jobs(s, d).withColumn("suspended_at", F.when(col("job_id") % 4 == 0, now())).withColumn("uninstalled_at", F.when(col("job_id") % 8 == 0, now()))


R.add(
    "a1_job_status", lambda s, d: a.job_status(_with_installation(s, d), now()).select("job_id", "status"),
    f"""SELECT job_id, CASE WHEN {_DEAD} THEN 'dead_pending' WHEN state = 'running' AND {_LOST} THEN 'stalled' WHEN state = 'running' THEN 'running' WHEN state = 'queued' AND job_id % 4 = 0 AND job_id % 8 <> 0 THEN 'deferred_suspended'
    WHEN state = 'queued' AND attempts > 0 THEN 'retrying' WHEN state = 'queued' AND run_after > {NOW_SQL} THEN 'scheduled' ELSE state END AS status FROM ({JOBS})""",
)
R.add("a2_claimable_jobs", lambda s, d: a.claimable_jobs(jobs(s, d), now(), 100).select("job_id", "state"), f"SELECT job_id, state FROM ({JOBS}) WHERE attempts < max_attempts AND ((state = 'queued' AND run_after <= {NOW_SQL}) OR (state = 'running' AND {_LOST})) ORDER BY run_after, job_id LIMIT 100")
R.add("a3_sweep_exhausted", lambda s, d: a.sweep_exhausted(jobs(s, d), now()).select("job_id", "state"), f"SELECT job_id, CASE WHEN {_DEAD} THEN 'dead' ELSE state END AS state FROM ({JOBS})")


def _one_live(s, d):
    """At most one live job for each repository: its newest; older live ones count as superseded."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("repository_id", col("state").isin("queued", "running")).orderBy(F.desc("job_id"))
    return jobs(s, d).withColumn("n", F.row_number().over(w)).withColumn("state", F.when((col("n") > 1) & col("state").isin("queued", "running"), "superseded").otherwise(col("state"))).drop("n")


_LIVE = f"(SELECT * REPLACE (CASE WHEN state IN ('queued', 'running') AND row_number() OVER (PARTITION BY repository_id, state IN ('queued', 'running') ORDER BY job_id DESC) > 1 THEN 'superseded' ELSE state END AS state) FROM ({JOBS}))"
R.add(
    "a4_coalesce_requests", lambda s, d: a.coalesce_requests(_one_live(s, d), table(s, d, "events").select(col("user_id").alias("repository_id"))),
    f"""WITH l AS (SELECT repository_id, job_id, state, needs_rerun FROM {_LIVE} WHERE state IN ('queued', 'running')), q AS (SELECT DISTINCT user_id AS repository_id FROM events)
    SELECT coalesce(l.repository_id, q.repository_id) AS repository_id, job_id, coalesce(state, 'queued') AS state, CASE WHEN job_id IS NULL THEN false ELSE needs_rerun OR q.repository_id IS NOT NULL END AS needs_rerun,
    CASE WHEN job_id IS NULL THEN 'insert' WHEN q.repository_id IS NOT NULL THEN 'flag' ELSE 'keep' END AS action FROM l FULL JOIN q ON l.repository_id = q.repository_id""",
)
R.add("a5_supersede_live", lambda s, d: a.supersede_live(jobs(s, d), table(s, d, "customer").filter("c_nationkey = 3").select(col("c_custkey").alias("repository_id"))).select("job_id", "state"),
      f"SELECT job_id, CASE WHEN state IN ('queued', 'running') AND repository_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN 'superseded' ELSE state END AS state FROM ({JOBS})")
_WHAT = ("complete", "fail", "reject", "defer", "abandon")
R.add(
    "a6_apply_outcomes",
    lambda s, d: a.apply_outcomes(jobs(s, d), jobs(s, d).filter("job_id % 2 = 0").select("job_id", F.concat(F.lit("w"), F.when(col("job_id") % 5 == 0, -1).otherwise(col("job_id") % 7).cast("string")).alias("owner"), F.element_at(F.array(*map(F.lit, _WHAT)), (col("job_id") % 11 % 5 + 1).cast("int")).alias("outcome"))),
    f"""WITH t AS (SELECT *, CASE WHEN job_id % 2 = 0 AND state = 'running' AND job_id % 5 <> 0 THEN ({list(_WHAT)!r})[job_id % 11 % 5 + 1] END AS o FROM ({JOBS})),
    x AS (SELECT job_id, repository_id, CASE o WHEN 'complete' THEN 'completed' WHEN 'reject' THEN 'rejected' WHEN 'abandon' THEN 'abandoned' WHEN 'defer' THEN 'queued' WHEN 'fail' THEN CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'queued' END ELSE state END AS state,
    CASE WHEN o = 'defer' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN o IS NULL THEN lease_owner END AS lease_owner, o = 'complete' AND needs_rerun AS again FROM t)
    SELECT job_id, repository_id, state, attempts, lease_owner FROM x UNION ALL SELECT CAST(NULL AS BIGINT), repository_id, 'queued', CAST(0 AS BIGINT), NULL FROM x WHERE again""",
)
R.add(
    "a7_sync_state", lambda s, d: a.project_sync_state(repositories(s, d), jobs(s, d)),
    f"""WITH b AS (SELECT * FROM ({JOBS}) QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY updated_at DESC, job_id DESC) = 1)
    SELECT c_custkey AS repository_id, CASE state WHEN 'completed' THEN 'synced' WHEN 'running' THEN 'syncing' WHEN 'queued' THEN 'pending' ELSE 'never' END AS sync_state FROM customer LEFT JOIN b ON repository_id = c_custkey""",
)


def _half_runs(s, d, part):
    return table(s, d, "orders").filter(col("o_orderkey") % 3 != part).select(col("o_custkey").alias("repository_id"), col("o_orderkey").alias("commit_id"), (col("o_orderkey") * (part + 1)).alias("started_at"), F.lit(f"p{part}").alias("branch"))


R.add("a8_upsert_runs", lambda s, d: a.upsert(_half_runs(s, d, 0), _half_runs(s, d, 1), ["repository_id", "commit_id"], ["started_at"]),
      "SELECT o_custkey AS repository_id, o_orderkey AS commit_id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey ELSE o_orderkey * 2 END AS started_at, CASE WHEN o_orderkey % 3 = 0 THEN 'p1' ELSE 'p0' END AS branch FROM orders")
R.add("a9_upsert_repositories", lambda s, d: a.upsert(table(s, d, "customer").filter("c_custkey % 2 = 0").select(col("c_custkey").alias("outer_id"), col("c_nationkey").alias("project_id"), col("c_name").alias("name")), table(s, d, "customer").filter("c_custkey % 3 = 0").select(col("c_custkey").alias("outer_id"), col("c_nationkey").alias("project_id"), F.upper("c_mktsegment").alias("name")), ["project_id", "outer_id"], ["name"]),
      "SELECT c_nationkey AS project_id, c_custkey AS outer_id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE c_name END AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
R.add("a10_prune", lambda s, d: a.prune(jobs(s, d), "updated_at", now(), 30, col("state").isin(*a.TERMINAL)).select("job_id"), f"SELECT job_id FROM ({JOBS}) WHERE NOT (state = 'completed' AND updated_at < {NOW_SQL} - INTERVAL 30 DAY)")
R.add(
    "a11_backfill_jobs",
    lambda s, d: a.backfill_jobs(table(s, d, "customer").select(col("c_custkey").alias("repository_id"), (col("c_custkey") % 90).alias("installation"), F.element_at(F.array(*map(F.lit, ("pending", "syncing", "synced"))), (col("c_custkey") % 3 + 1).cast("int")).alias("sync_state")), _states(s, d), jobs(s, d).filter("repository_id % 2 = 0")),
    f"""SELECT c_custkey AS repository_id, CASE WHEN c_custkey % 90 IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0) THEN 'enqueue' ELSE 'stand_down' END AS action
    FROM customer WHERE c_custkey % 3 < 2 AND c_custkey NOT IN (SELECT repository_id FROM ({JOBS}) WHERE repository_id % 2 = 0 AND state IN ('queued', 'running'))""",
)


def _symbols(s, d, keep):
    return table(s, d, "part").filter(keep).select((col("p_partkey") % 9).alias("repository_id"), col("p_brand").alias("file_path"), col("p_name").alias("symbol_path"), F.lit("f").alias("kind"), col("p_partkey").alias("ordinal"))


R.add(
    "a12_archive_symbols",
    lambda s, d: a.archive_symbols(_symbols(s, d, "p_partkey % 4 <> 0").withColumn("archived_at", F.when(col("ordinal") % 5 == 0, "2020-01-01").cast("timestamp")), _symbols(s, d, "p_partkey % 3 <> 0"), now()).groupBy("action", F.col("archived_at").isNull().alias("live")).agg(F.count(F.lit(1)).alias("n"), F.sum("ordinal").alias("of")),
    """WITH x AS (SELECT p_partkey AS k, p_partkey % 4 <> 0 AS was, p_partkey % 3 <> 0 AS here, p_partkey % 5 = 0 AS gone FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 3 <> 0)
    SELECT CASE WHEN NOT was THEN 'added' WHEN NOT here AND NOT gone THEN 'archived' WHEN here AND gone THEN 'resurrected' ELSE 'kept' END AS action, here AS live, count(*) AS n, CAST(sum(k) AS BIGINT) AS "of" FROM x GROUP BY 1, 2""",
)
R.add("a13_progress_fields", lambda s, d: a.progress_fields(table(s, d, "events").select("event_id", "props"), "props", "k", "chunks").select("event_id", "k", "chunks"), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS chunks FROM events")
R.add("a14_backfill_org", lambda s, d: a.backfill_org(table(s, d, "customer").select("c_custkey", col("c_nationkey").alias("project_id"), F.when(col("c_custkey") % 2 == 0, 99).alias("organization_id")), projects(s, d)).select("c_custkey", "organization_id"), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 99 ELSE n_regionkey END AS organization_id FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
R.add("a15_discovery_index", lambda s, d: a.build_discovery_index(table(s, d, "orders").select(col("o_custkey").alias("installation"), (col("o_orderkey") % 25).alias("organization"), (col("o_orderkey") % 10 == 0).alias("rekeyed"), col("o_orderdate").alias("created_at"))), "SELECT o_custkey AS installation, o_orderkey % 25 AS organization FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 10 = 0 DESC, o_orderdate, o_orderkey % 25) = 1")
R.add("a16_upsert_installations", lambda s, d: a.upsert_installations(table(s, d, "customer").filter("c_custkey % 2 = 0").select(col("c_custkey").alias("installation"), col("c_nationkey").alias("organization"), F.lit("old").alias("status")), table(s, d, "customer").filter("c_custkey % 3 = 0").select(col("c_custkey").alias("installation"), F.when(col("c_custkey") % 4 == 0, 77).otherwise(col("c_nationkey")).alias("organization"), F.lit("new").alias("status"))),
      """SELECT c_custkey AS installation, CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 4 = 0 THEN 77 ELSE c_nationkey END AS organization, CASE WHEN c_custkey % 3 = 0 AND (c_custkey % 2 <> 0 OR c_custkey % 4 <> 0) THEN 'new' ELSE 'old' END AS status,
      CASE WHEN c_custkey % 2 <> 0 THEN 'inserted' WHEN c_custkey % 3 <> 0 THEN 'kept' WHEN c_custkey % 4 <> 0 THEN 'replaced' ELSE 'refused' END AS outcome FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")  # fmt: skip

R.add(
    "v1_check_domains",
    lambda s, d: v.check_domains(table(s, d, "lineitem").withColumn("id", col("l_orderkey") * 10 + col("l_linenumber")), "id", {"returnflag": col("l_returnflag").isin("A", "N"), "quantity": col("l_quantity") <= 49, "discount": col("l_discount") >= 0}),
    "WITH l AS (SELECT *, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id FROM lineitem) SELECT 'returnflag' AS \"check\", id AS key, 'returnflag' AS detail FROM l WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'quantity', id, 'quantity' FROM l WHERE NOT l_quantity <= 49 UNION ALL SELECT 'discount', id, 'discount' FROM l WHERE NOT l_discount >= 0",
)
R.add(
    "v2_check_foreign_keys",
    lambda s, d: v.check_foreign_keys(table(s, d, "orders"), table(s, d, "customer").filter("c_custkey % 5 <> 0").select(col("c_custkey").alias("k"), (col("c_custkey") % 2).alias("p")).withColumn("p", col("p")), {"o_custkey": "k"}, "order_customer", "o_orderkey"),
    "SELECT 'order_customer' AS \"check\", CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)",
)
R.add("v3_check_unique", lambda s, d: v.check_unique(jobs(s, d), ["repository_id"], "one_live", col("state").isin("queued", "running")), f"SELECT 'one_live' AS \"check\", CAST(repository_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM ({JOBS}) WHERE state IN ('queued', 'running') GROUP BY repository_id HAVING count(*) > 1")
_DRIFTED = lambda s, d: table(s, d, "customer").select(col("c_custkey").alias("repository_id"), col("c_nationkey").alias("project_id"), (col("c_custkey") % 5).cast("int").alias("organization_id"))
R.add("v4_repository_tenant_drift", lambda s, d: v.repository_tenant_drift(_DRIFTED(s, d), projects(s, d)), "SELECT 'repository_tenant' AS \"check\", CAST(c_custkey AS VARCHAR) AS key, CAST(n_regionkey AS VARCHAR) AS detail FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> c_custkey % 5")
R.add(
    "v5_chunk_tenant_drift",
    lambda s, d: v.chunk_tenant_drift(
        table(s, d, "lineitem").select((col("l_orderkey") * 10 + col("l_linenumber")).alias("chunk_id"), (col("l_partkey") % 200).alias("repository_id"), (col("l_suppkey") % 5).cast("int").alias("organization_id"), col("l_orderkey").alias("run_id"), F.when(col("l_linenumber") > 1, col("l_partkey")).alias("symbol_id")),
        table(s, d, "part").select(col("p_partkey").alias("symbol_id"), (col("p_partkey") % 150).alias("repository_id"), (col("p_size") % 5).alias("organization_id")), _DRIFTED(s, d), runs(s, d)),
    """WITH c AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id, l_partkey % 200 AS r, l_suppkey % 5 AS o, l_orderkey AS run, CASE WHEN l_linenumber > 1 THEN l_partkey END AS sym FROM lineitem), k AS (SELECT c_custkey AS r, CAST(c_custkey % 5 AS INTEGER) AS o FROM customer)
    SELECT 'chunk_organization' AS "check", id AS key, CAST(k.o AS VARCHAR) AS detail FROM c LEFT JOIN k USING (r) WHERE k.o IS DISTINCT FROM c.o
    UNION ALL SELECT 'symbol_organization', CAST(p_partkey AS VARCHAR), CAST(k.o AS VARCHAR) FROM part LEFT JOIN k ON k.r = p_partkey % 150 WHERE k.o IS DISTINCT FROM p_size % 5
    UNION ALL SELECT 'chunk_run', id, CAST(o_custkey AS VARCHAR) FROM c LEFT JOIN orders ON o_orderkey = run WHERE o_custkey IS DISTINCT FROM r
    UNION ALL SELECT 'chunk_symbol', id, CAST(p_partkey % 150 AS VARCHAR) FROM c LEFT JOIN part ON p_partkey = sym WHERE sym IS NOT NULL AND p_partkey % 150 IS DISTINCT FROM r""",
)
R.add("v7_breadcrumb_mismatch", lambda s, d: v.breadcrumb_mismatch(table(s, d, "part").select(col("p_partkey").alias("chunk_id"), F.when(col("p_partkey") % 3 == 0, "").otherwise(col("p_brand")).alias("breadcrumb"), F.when(col("p_partkey") % 6 > 1, col("p_brand")).alias("meta_breadcrumb"))),
      "WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS b, CASE WHEN p_partkey % 6 > 1 THEN p_brand END AS m FROM part) SELECT 'breadcrumb' AS \"check\", CAST(k AS VARCHAR) AS key, m AS detail FROM p WHERE b IS DISTINCT FROM m")
R.add(
    "v10_check_targets",
    lambda s, d: v.check_targets(
        table(s, d, "orders").select(col("o_orderkey").alias("id"), F.concat(F.lit("f"), (col("o_custkey") % 300).cast("string")).alias("path"), F.concat(F.lit("S"), (col("o_orderkey") % 50).cast("string")).alias("symbol"), F.concat(F.lit("what is s"), (col("o_orderkey") % 70).cast("string"), F.lit("?")).alias("question")),
        table(s, d, "customer").select(F.concat(F.lit("f"), col("c_custkey").cast("string")).alias("path")), table(s, d, "part").filter("p_size < 40").select(F.concat(F.lit("pkg.S"), col("p_size").cast("string")).alias("breadcrumb"))),
    """WITH q AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'f' || (o_custkey % 300) AS path, 'S' || (o_orderkey % 50) AS symbol, 'what is s' || (o_orderkey % 70) || '?' AS question FROM orders)
    SELECT 'file_missing' AS "check", id AS key, path AS detail FROM q WHERE path NOT IN (SELECT 'f' || c_custkey FROM customer) UNION ALL SELECT 'symbol_missing', id, symbol FROM q WHERE symbol NOT IN (SELECT 'S' || p_size FROM part WHERE p_size < 40)
    UNION ALL SELECT 'symbol_told', id, symbol FROM q WHERE contains(lower(question), lower(symbol))""",
)
_SPEC = lambda s, d: table(s, d, "orders").select((col("o_orderkey") % 1400).alias("id"), F.when(col("o_orderkey") % 9 == 0, "odd").otherwise("tuning").alias("set"), F.when(col("o_orderkey") % 8 > 0, col("o_orderpriority")).alias("question"), F.lit("p").alias("path"), F.when(col("o_orderkey") % 7 == 0, " ").alias("symbol"), F.substring(F.sha2(col("o_orderkey").cast("string"), 256), 1, 40).alias("commit"))
R.add(
    "v9_check_question_specs", lambda s, d: v.check_question_specs(_SPEC(s, d), ("tuning", "holdout")),
    """WITH q AS (SELECT o_orderkey AS k, CAST(o_orderkey % 1400 AS VARCHAR) AS id FROM orders) SELECT 'set' AS "check", id AS key, 'set' AS detail FROM q WHERE k % 9 = 0 UNION ALL SELECT 'question', id, 'question' FROM q WHERE k % 8 = 0
    UNION ALL SELECT 'symbol', id, 'symbol' FROM q WHERE k % 7 = 0 UNION ALL SELECT 'unique_id', id, CAST(count(*) AS VARCHAR) FROM q GROUP BY id HAVING count(*) > 1""",
)
_CLAUSE = lambda s, d: table(s, d, "orders").select(col("o_orderkey").alias("id"), F.when(col("o_orderkey") % 5 == 0, "line").otherwise("file").alias("level"), F.lit("pooled").alias("scope"), F.when(col("o_orderkey") % 6 == 0, F.lit(float("inf"))).otherwise(F.lit(0.01)).alias("min_delta"), F.when(col("o_orderkey") % 4 == 0, 1e-3).otherwise(1e-9).alias("allowance"))
R.add("v8_check_rule_schema", lambda s, d: v.check_rule_schema(_CLAUSE(s, d)),
      "WITH q AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id FROM orders) SELECT 'level' AS \"check\", id AS key, 'level' AS detail FROM q WHERE k % 5 = 0 UNION ALL SELECT 'min_delta', id, 'min_delta' FROM q WHERE k % 6 = 0 UNION ALL SELECT 'allowance', id, 'allowance' FROM q WHERE k % 4 = 0")
_RUN = lambda s, d, n: table(s, d, "orders").filter(col("o_orderkey") % n != 0).select(col("o_orderkey").alias("id"), F.when(col("o_orderkey") % (n * 3) == 1, f"q{n}").otherwise("q").alias("question"), F.lit("tuning").alias("set"), F.sha2(col("o_orderkey").cast("string"), 256).alias("vector_hash"), F.when(col("o_orderkey") % 40 == 1, "boom").alias("error"))
R.add(
    "v6_comparable_runs", lambda s, d: v.check_comparable_runs(_RUN(s, d, 10), _RUN(s, d, 7)),
    """WITH k AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 10 <> 0 AS b, o_orderkey % 7 <> 0 AS a FROM orders)
    SELECT 'missing' AS "check", id AS key, 'missing' AS detail FROM k WHERE a <> b UNION ALL SELECT 'question', id, 'question' FROM k WHERE a AND b AND (CASE WHEN k % 30 = 1 THEN 'q10' ELSE 'q' END) <> (CASE WHEN k % 21 = 1 THEN 'q7' ELSE 'q' END)
    UNION ALL SELECT 'failed', id, 'failed' FROM k WHERE (a OR b) AND k % 40 = 1""",
)


def _headers(s, d, turn):
    """Customers as corpora, with the settings of a run."""
    c = table(s, d, "customer")
    return c.filter(col("c_custkey") % turn > 0).select(col("c_custkey").cast("string").alias("corpus"), (5 + (col("c_custkey") % (turn * 2) == 1).cast("int")).alias("top_k"), F.when(col("c_custkey") % 3 > 0, F.lit("m")).alias("model"))


_HEADERS = "SELECT CAST(c_custkey AS VARCHAR) AS corpus, 5 + CAST(c_custkey % {0} = 1 AS INTEGER) AS top_k FROM customer WHERE c_custkey % {1} > 0"
R.add(
    "v6_comparable_headers", lambda s, d: v.check_comparable_headers(_headers(s, d, 10), _headers(s, d, 7), ["top_k", "model"], ["corpus"]),
    f"""WITH j AS (SELECT coalesce(b.corpus, a.corpus) AS key, b.top_k AS b, a.top_k AS a FROM ({_HEADERS.format(20, 10)}) b FULL JOIN ({_HEADERS.format(14, 7)}) a ON a.corpus = b.corpus)
    SELECT 'missing_header' AS "check", key, 'missing_header' AS detail FROM j WHERE a IS NULL OR b IS NULL UNION ALL SELECT 'setting_top_k', key, b || ' -> ' || a FROM j WHERE a <> b""",
)
R.add(
    "v6_recorded_ranks",
    lambda s, d: v.check_recorded_ranks(
        table(s, d, "orders").select(col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("f"), (col("o_orderkey") % 5).cast("string")).alias("path"), F.when(col("o_orderkey") % 3 > 0, col("o_orderkey") % 4).alias("file_rank")),
        table(s, d, "lineitem").select(col("l_orderkey").cast("string").alias("id"), col("l_linenumber").cast("long").alias("rank"), F.concat(F.lit("f"), (col("l_partkey") % 5).cast("string")).alias("file_path")),
    ),
    """WITH q AS (SELECT o_orderkey AS k, o_orderkey % 5 AS p, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS said FROM orders), t AS (SELECT k, min(l_linenumber) AS again FROM q JOIN lineitem ON l_orderkey = k AND l_partkey % 5 = p GROUP BY k)
    SELECT 'rank' AS "check", CAST(k AS VARCHAR) AS key, coalesce(CAST(said AS VARCHAR), 'none') || ' for ' || coalesce(CAST(again AS VARCHAR), 'none') AS detail FROM q LEFT JOIN t USING (k) WHERE said IS DISTINCT FROM again""",
)
