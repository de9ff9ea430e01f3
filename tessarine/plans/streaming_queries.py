"""Registered queries of the event streams, drained and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.operators.chunking import chunk_fixed
from tessarine.operators.lineage import LIVE
from tessarine.plans.chunk_queries import OVERLAP, SIZE, _spans_sql
from tessarine.plans.roles import DELIVERIES, Registry, deliveries, jobs, table
from tessarine.streaming import events as t
from tessarine.sources.snapshots import LedgerSink
from tessarine.streaming.run import drain, drain_idle, drain_windows, scratch

R = Registry()
col = F.col


def table_stream(s, d, name):
    """A table as a stream of its files."""
    path = f"{d}/{name}.parquet"
    whole = s.read.parquet(path)
    first = whole.select(F.input_file_name()).first()
    single = first is not None and first[0].rstrip("/").endswith(f"{name}.parquet")
    reader = s.readStream.schema(whole.schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if single else reader.parquet(path)


def event_stream(s, d):
    """The events table as a stream of files."""
    return table_stream(s, d, "events").select(col("event_id").alias("delivery_id"), col("event_type").alias("event"), col("user_id").alias("installation"), col("ts").cast("timestamp").alias("received_at"))


def _twice(s, d):
    e = event_stream(s, d)
    return e.select("*", F.explode(F.when(col("delivery_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again")


R.add("d1_dedupe_deliveries", lambda s, d: drain(t.dedupe_deliveries(_twice(s, d))).select("delivery_id", "event"), f"SELECT delivery_id, event FROM ({DELIVERIES})")


def _reclaimed(s, d):
    outcome = F.when(col("event") == "error", "failed").when(col("event") == "view", "processing").otherwise("done")
    e = event_stream(s, d).select((col("delivery_id") % 200).alias("delivery_id"), "received_at", outcome.alias("outcome"))
    return drain(t.reclaim_deliveries(e)).groupBy("delivery_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passes").alias("passed"))


#: Each id's deliveries in order, with the last one that passed and when.
R.add(
    "d2_reclaim_deliveries",
    _reclaimed,
    """WITH RECURSIVE e AS (SELECT event_id % 200 AS id, epoch(ts) AS tm, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'done' END AS outcome FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tm, outcome) AS i FROM e),
    w AS (SELECT id, i, true AS passes, outcome, tm FROM o WHERE i = 1
      UNION ALL SELECT id, i, p, CASE WHEN p THEN o_outcome ELSE outcome END, CASE WHEN p THEN o_tm ELSE tm END FROM (
        SELECT w.id, o.i, w.outcome = 'failed' OR (w.outcome = 'processing' AND o.tm - w.tm > 300) AS p, o.outcome AS o_outcome, o.tm AS o_tm, w.outcome, w.tm FROM w JOIN o ON o.id = w.id AND o.i = w.i + 1))
    SELECT id AS delivery_id, count(*) AS n, count(*) FILTER (WHERE passes) AS passed FROM w GROUP BY 1""",
)
_EVENTS = {"purchase": "push", "signup": "installation", "error": "installation_repositories", "view": "ping", "click": "star"}
_ROUTED_ACTIONS = ("created", "deleted", "suspend", "unsuspend", "added", "removed")


def _routed(s, d):
    event = F.lit(None).cast("string")
    for kind, name in _EVENTS.items():
        event = F.when(col("event") == kind, name).otherwise(event)
    action = F.element_at(F.array(*map(F.lit, _ROUTED_ACTIONS)), (col("delivery_id") % 6 + 1).cast("int"))
    return t.route_events(deliveries(s, d).select(event.alias("event"), action.alias("action"))).groupBy("handler").agg(F.count(F.lit(1)).alias("n"))


_CASES = " ".join(f"WHEN event = '{e}'" + (f" AND action = '{a}'" if a else "") + f" THEN '{h}'" for (e, a), h in t.ROUTES.items())
R.add(
    "d3_route_events",
    _routed,
    f"""WITH e AS (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENTS.items())} END AS event, ({list(_ROUTED_ACTIONS)!r})[event_id % 6 + 1] AS action FROM events)
    SELECT CASE {_CASES} ELSE 'ignored' END AS handler, count(*) AS n FROM e GROUP BY 1""",
)


def _collected(s, stream_writer, label, schema):
    """The rows that a writer of micro-batches leaves in the shared folder, each batch once."""
    sink = LedgerSink(s, scratch(s, label))
    query = stream_writer(sink).option("checkpointLocation", scratch(s, label + "-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.read(schema)


def _push_jobs(s, d):
    index = table(s, d, "customer").select(col("c_custkey").alias("installation"), col("c_nationkey").alias("organization"), (col("c_custkey") % 700).alias("repository_id"))
    live = jobs(s, d).filter(col("state").isin(*LIVE)).groupBy("repository_id").agg(F.max("job_id").alias("job_id"), F.lit("queued").alias("state"), F.lit(False).alias("needs_rerun"))
    pushes = event_stream(s, d).filter("event = 'purchase'")
    write = lambda sink: t.push_to_jobs(pushes, index, lambda: live, lambda df, n: sink(df.filter("action <> 'keep'").select("repository_id", "action"), n))
    return _collected(s, write, "jobs", "repository_id long, action string")


R.add(
    "d6_push_to_jobs",
    _push_jobs,
    """SELECT DISTINCT c_custkey % 700 AS repository_id, CASE WHEN c_custkey % 700 IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P')) THEN 'flag' ELSE 'insert' END AS action
    FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'""",
)


def _chunked(s, d):
    """Documents as files, of which every third comes a second time unchanged."""
    files = table_stream(s, d, "documents").select("doc_id", col("doc_id").cast("string").alias("path"), col("text").alias("content"), F.timestamp_seconds("doc_id").alias("arrived_at"))
    again = F.explode(F.when(col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(60))).otherwise(F.array(F.lit(0))))
    files = files.withColumn("again", again).withColumn("arrived_at", F.timestamp_add("SECOND", col("again"), col("arrived_at"))).drop("again")
    chunks = lambda df: chunk_fixed(df, SIZE, OVERLAP).select("path", "doc_id", "start_line", "end_line")
    write = lambda sink: t.stream_chunks(files, chunks, lambda df, n: sink(df.select("path", "doc_id", "start_line", "end_line", "arrived_at"), n))
    return t.current_chunks(_collected(s, write, "chunks", "path string, doc_id long, start_line long, end_line long, arrived_at timestamp")).select("doc_id", "start_line", "end_line")


R.add("c15_stream_chunks", _chunked, f"WITH {_spans_sql(SIZE, OVERLAP)} SELECT doc_id, start_line, end_line FROM chunks")


def _cached(s, d):
    e = table_stream(s, d, "embeddings").select((col("label") % 2).cast("long").alias("organization"), col("label").cast("string").alias("repository"), col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return drain_idle(t.stream_semantic_cache(e, 0.3))


R.add("r21_stream_semantic_cache", _cached)
_ACTIONS = ("created", "suspend", "unsuspend", "deleted")
R.add(
    "d4_installation_state",
    lambda s, d: t.installation_state(deliveries(s, d).select("installation", F.element_at(F.array(*map(F.lit, _ACTIONS)), (col("delivery_id") % 7 % 4 + 1).cast("int")).alias("action"), (col("delivery_id") * 1000).cast("timestamp").alias("received_at"))).select("installation", col("suspended_at").isNotNull().alias("suspended"), col("uninstalled_at").isNotNull().alias("uninstalled")),
    f"""WITH e AS (SELECT user_id AS i, ({list(_ACTIONS)!r})[event_id % 7 % 4 + 1] AS a, event_id FROM events)
    SELECT i AS installation, coalesce(arg_max(a, event_id) FILTER (WHERE a IN ('suspend', 'unsuspend')) = 'suspend', false) AS suspended, coalesce(arg_max(a, event_id) FILTER (WHERE a IN ('created', 'deleted')) = 'deleted', false) AS uninstalled FROM e GROUP BY 1""",
)
R.add(
    "d5_repository_membership",
    lambda s, d: t.repository_membership(table(s, d, "events").select("event_id", (col("user_id") % 9).alias("installation"), col("ts").alias("received_at"), F.when(col("event_type") == "error", "removed").otherwise("added").alias("action"), F.array(col("event_id") % 120, col("event_id") % 77 + 200).alias("repositories"))),
    """WITH e AS (SELECT event_id, ts, user_id % 9 AS i, event_type = 'error' AS gone, unnest([event_id % 120, event_id % 77 + 200]) AS r FROM events),
    w AS (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY ts, event_id) AS was, row_number() OVER (PARTITION BY r ORDER BY ts DESC, event_id DESC) AS n FROM e)
    SELECT r AS repository_id, i AS installation, CASE WHEN gone THEN 'stand_down' WHEN was IS NOT NULL AND was <> i THEN 'supersede_and_enqueue' ELSE 'enqueue' END AS action FROM w WHERE n = 1""",
)
R.add("d7_heartbeat_gaps", lambda s, d: t.heartbeat_gaps(table(s, d, "events").select(col("user_id").alias("worker"), col("ts").cast("timestamp").alias("beat")), F.lit("2100-01-01").cast("timestamp"), 3600).groupBy("worker").agg(F.count(F.lit(1)).alias("gaps")),
      """WITH b AS (SELECT user_id AS worker, ts, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), TIMESTAMP '2100-01-01') AS nx FROM events)
      SELECT worker, count(DISTINCT ts) AS gaps FROM b WHERE floor(epoch(nx)) - floor(epoch(ts)) > 3600 GROUP BY 1""")  # fmt: skip
R.add("d7_heartbeat_timeout", lambda s, d: drain(t.heartbeat_timeout(event_stream(s, d).select(col("installation").alias("worker"), col("received_at").alias("beat")))))
R.add("d8_outcome_counts", lambda s, d: t.outcome_counts(deliveries(s, d)).select(col("window_start").cast("timestamp_ntz").alias("window_start"), "event", "n"),
      "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2")

R.add("d7_job_watch", lambda s, d: drain(t.job_watch(event_stream(s, d).select((col("installation") % 40).alias("worker"), col("received_at").alias("beat")))),
      f"""WITH b AS (SELECT user_id % 40 AS worker, epoch_us(ts) // 1000 AS tm FROM events), g AS (SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY worker ORDER BY tm) <= {t.STALL_SECONDS * 1000} THEN 0 ELSE 1 END AS new FROM b),
      r AS (SELECT worker, tm, sum(new) OVER (PARTITION BY worker ORDER BY tm ROWS UNBOUNDED PRECEDING) AS run FROM g), v AS (SELECT worker, min(tm) AS started, max(tm) + {t.STALL_SECONDS * 1000} AS stalled, min(tm) + {t.MOST_WORK_SECONDS * 1000} AS cut FROM r GROUP BY worker, run)
      SELECT worker, started, CASE WHEN cut < stalled THEN 'cut_loose' ELSE 'stalled' END AS verdict, least(cut, stalled) AS "at" FROM v, (SELECT max(tm) AS now FROM b) WHERE least(cut, stalled + 1) <= now""")  # fmt: skip
_OUTCOMES = ("done", "failed", "ignored")


def _windows(s, d):
    """Events in four files by time, each up to eight minutes out of order."""
    e = table(s, d, "events").select(col("event_id"), col("event_type").alias("event"), F.element_at(F.array(*map(F.lit, _OUTCOMES)), (col("event_id") % 3 + 1).cast("int")).alias("outcome"), col("ts").cast("timestamp").alias("received_at"))
    first, last = e.agg(F.min("received_at").cast("double"), F.max("received_at").cast("double")).first()
    path = scratch(s, "disordered")
    arrives = col("received_at").cast("double") - first + (col("event_id") % 9) * 60
    dealt = e.withColumn("file", F.least(F.floor(4 * arrives / (last - first + 1)), F.lit(3)))
    for k in range(4):
        dealt.filter(col("file") == k).drop("file", "event_id").coalesce(1).write.mode("append").parquet(path)
    stream = s.readStream.schema("event string, outcome string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return drain_windows(t.outcome_counts(stream, by=("event", "outcome")))[0].select(col("window_start").cast("timestamp_ntz").alias("window_start"), "event", "outcome", "n")


R.add("d8_final_windows", _windows,
      f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS event, ({list(_OUTCOMES)!r})[event_id % 3 + 1] AS outcome, count(*) AS n FROM events
      WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2, 3""")  # fmt: skip
