"""Delivery events as streams, with batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tessarine.operators.jobs import coalesce_requests
from tessarine.operators.lineage import latest_per, resolve_installation
from tessarine.shared import free, materialize
from tessarine.streaming.run import keep_state

RETENTION = "30 days"
RECLAIM_SECONDS, STALL_SECONDS, MOST_WORK_SECONDS = 300, 300, 7200
#: Which events and actions go to which handler; None is any action.
ROUTES = {
    ("ping", None): "pong", ("push", None): "push",
    ("installation", "created"): "installation_created", ("installation", "deleted"): "installation_deleted",
    ("installation", "suspend"): "installation_suspended", ("installation", "unsuspend"): "installation_unsuspended",
    ("installation", "new_permissions_accepted"): "permissions_accepted",
    ("installation_repositories", "added"): "repositories_added", ("installation_repositories", "removed"): "repositories_removed",
}


def dedupe_deliveries(deliveries: DataFrame) -> DataFrame:
    """The first delivery of each id; repeats within the retention are dropped, in a stream by watermark."""
    if deliveries.isStreaming:
        return deliveries.withWatermark("received_at", RETENTION).dropDuplicatesWithinWatermark(["delivery_id"])
    return latest_per(deliveries, ["delivery_id"], F.col("received_at"), F.col("event"))


def route_events(deliveries: DataFrame, routes: dict[tuple[str, str | None], str] | None = None) -> DataFrame:
    """``deliveries`` (event, action) with their ``handler``; what no route names, and any null event, is ignored."""
    out = F.lit("ignored")
    for (event, action), handler in (routes or ROUTES).items():
        here = F.col("event") == event
        out = F.when(here if action is None else here & (F.col("action") == action), handler).otherwise(out)
    return deliveries.withColumn("handler", out)


def installation_state(events: DataFrame) -> DataFrame:
    """(installation, suspended_at, uninstalled_at) after all events (installation, action, received_at), the latest deciding."""
    mark = lambda on, off: F.max(F.when(F.col("action").isin(on, off), F.struct("received_at", (F.col("action") == on).alias("set"))))
    g = events.groupBy("installation").agg(mark("suspend", "unsuspend").alias("s"), mark("deleted", "created").alias("u"))
    return g.select("installation", F.when(F.col("s.set"), F.col("s.received_at")).alias("suspended_at"), F.when(F.col("u.set"), F.col("u.received_at")).alias("uninstalled_at"))


def repository_membership(events: DataFrame) -> DataFrame:
    """(repository_id, installation, action) by the latest event of each repository, out of added and removed id lists.

    added re-points and enqueues; a repository that came from another installation is superseded first; removed stands down.
    """
    each = events.select("installation", "received_at", "event_id", F.explode("repositories").alias("repository_id"), "action")
    w = Window.partitionBy("repository_id").orderBy("received_at", "event_id")
    seen = each.withColumn("was", F.lag("installation").over(w)).withColumn("_n", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("received_at"), F.desc("event_id"))))
    verdict = F.when(F.col("action") == "removed", "stand_down").when(F.col("was").isNotNull() & (F.col("was") != F.col("installation")), "supersede_and_enqueue").otherwise("enqueue")
    return seen.filter("_n = 1").select("repository_id", "installation", verdict.alias("action"))


LATENESS = "10 minutes"


def outcome_counts(deliveries: DataFrame, every: str = "1 hour", by: tuple[str, ...] = ("event",)) -> DataFrame:
    """Deliveries per time window and the columns in ``by``.

    In a stream a window comes out once, when the watermark, LATENESS behind the latest row, has passed its end; rows of a closed
    window are dropped, and ``run.drain_windows`` counts them. In a batch every window comes out.
    """
    rows = deliveries.withWatermark("received_at", LATENESS) if deliveries.isStreaming else deliveries
    return rows.groupBy(F.window("received_at", every).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def heartbeat_gaps(beats: DataFrame, until: Column, seconds: int = STALL_SECONDS) -> DataFrame:
    """The batch twin of the timeout: (worker, beat) after which no beat came for more than ``seconds``, up to ``until``."""
    w = Window.partitionBy("worker").orderBy("beat")
    after = F.coalesce(F.lead("beat").over(w), until)
    return beats.withColumn("_next", after).filter(F.col("_next").cast("long") - F.col("beat").cast("long") > seconds).select("worker", "beat").distinct()


def push_to_jobs(deliveries: DataFrame, index: DataFrame, live_jobs: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]):
    """A stream writer: pushes of connected repositories become coalesced requests, one batch at a time."""

    def apply(batch: DataFrame, epoch: int) -> None:
        known = resolve_installation(batch, index).filter("outcome = 'resolved'")
        write(coalesce_requests(live_jobs(), known.select("repository_id")), epoch)

    return deliveries.writeStream.foreachBatch(apply)


def _ms(at) -> int:
    return pd.Timestamp(at).value // 10**6


def _changed(columns: list[str], keep_ms: int):
    """Passes a file on when its content's digest isn't the one last seen at its path; of a batch's versions the latest counts."""

    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = None
        for part in rows:
            own = part.sort_values(["arrived_at", "digest"]).iloc[[-1]] if len(part) > 1 else part
            place = own["arrived_at"].iloc[0], own["digest"].iloc[0]
            if newest is None or place >= last:
                newest, last = own, place
        digest, at = last[1], _ms(last[0])
        known = state.get if state.exists else None
        old = known is not None and at < known[1]  # than what was passed on
        if not old:
            state.update((digest, at))
        state.setTimeoutTimestamp(max((known[1] if old else at) + keep_ms, state.getCurrentWatermarkMs() + 1))
        if not old and (known is None or known[0] != digest):
            yield newest[columns]

    return run


def changed_files(files: DataFrame, keep_days: int = 30) -> DataFrame:
    """A stream of files (path, content, arrived_at, ...) without those whose content is what was last seen at their path.

    A path's digest is forgotten once event time is ``keep_days`` past its last arrival; a file that comes after that counts as new.
    Its content passes through, but only the digest is kept. Files without a path are dropped. States go to the tasks in Arrow
    batches with their rows, not in calls for each path.
    """
    columns = files.columns
    marked = files.filter("path IS NOT NULL").withColumn("digest", F.sha2(F.coalesce("content", F.lit("")), 256)).withWatermark("arrived_at", "0 seconds")
    return marked.groupBy("path").applyInPandasWithState(_changed(columns, keep_days * 86_400_000), files.schema, "digest string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_chunks(files: DataFrame, chunker: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], keep_days: int = 30):
    """A stream writer: files that are new or changed are chunked and written with ``arrived_at``; see ``changed_files``.

    A file that gives no chunks is written as one row with null lines, so that ``current_chunks`` knows that its chunks are gone.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        passed = materialize(batch, "passed")  # read twice below: the state would be gone through as often
        kept = passed.select("path", "arrived_at").withColumnRenamed("arrived_at", "_at")
        chunks = chunker(passed)
        write(kept.join(chunks.drop("arrived_at"), "path", "left").withColumnRenamed("_at", "arrived_at"), epoch)
        free(passed)

    keep_state(files.sparkSession)
    return changed_files(files, keep_days).writeStream.foreachBatch(apply)


def current_chunks(written: DataFrame) -> DataFrame:
    """Of all chunks that were written, those of each path's latest version."""
    newest = F.max("arrived_at").over(Window.partitionBy("path"))
    return written.withColumn("_newest", newest).filter((F.col("arrived_at") == F.col("_newest")) & F.col("start_line").isNotNull()).drop("_newest")


class Reclaim(StatefulProcessor):
    """Deliveries by time, then outcome. A repeat passes when the last outcome failed, or has been processing for over five minutes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "outcome string, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["received_at", "outcome"])
        known = self.last.get() if self.last.exists() else None
        out = []
        for at, outcome in zip(events["received_at"].astype("int64") / 10 ** (9 if events["received_at"].dtype.str.endswith("[ns]") else 6), events["outcome"], strict=True):
            passes = known is None or known[0] == "failed" or (known[0] == "processing" and at - known[1] > RECLAIM_SECONDS)
            out.append((key[0], float(at), bool(passes)))
            if passes:
                known = (outcome, float(at))
        self.last.update(known)
        yield pd.DataFrame(out, columns=["delivery_id", "at", "passes"])

    def close(self) -> None:
        return


def reclaim_deliveries(deliveries: DataFrame) -> DataFrame:
    """(delivery_id, at, passes) of a stream of (delivery_id, received_at, outcome)."""
    return deliveries.groupBy("delivery_id").transformWithStateInPandas(Reclaim(), "delivery_id long, at double, passes boolean", "append", "none")


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


class SemanticCache(StatefulProcessor):
    """Answers queries from a cache per (organization, repository); entries expire by time to live.

    A query is answered by the nearest entry of cosine ``least`` or more, of equal ones by that with the smallest id;
    else it becomes an entry itself. A batch's queries are taken in the order of their ids.
    """

    def __init__(self, least: float = 0.95, ttl_ms: int = 3_600_000) -> None:
        self.least, self.ttl_ms = least, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "query_id long", "embedding array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys, kept = [], []
        for k, v in self.entries.iterator():
            keys.append(k[0]), kept.append(v[0])
        asked = pd.concat(list(rows)).sort_values("query_id")
        vectors = _unit(np.array(asked["embedding"].tolist(), float))
        ids = np.concatenate([np.array(keys, np.int64), asked["query_id"].to_numpy(np.int64)])
        known = np.concatenate([_unit(np.array(kept, float)), vectors]) if kept else vectors
        there = np.concatenate([np.ones(len(keys), bool), np.zeros(len(asked), bool)])
        out = []
        for i, (query_id, v, whole) in enumerate(zip(asked["query_id"], vectors, asked["embedding"], strict=True), len(keys)):
            held = np.flatnonzero(there)
            scores = known[held] @ v
            near = held[np.flatnonzero(scores >= max(self.least, scores.max()))] if len(held) else held
            hit = len(near) > 0
            out.append((query_id, hit, int(ids[near].min()) if hit else None))
            if not hit:
                there[i] = True
                self.entries.updateValue((int(query_id),), (list(map(float, whole)),))
        yield pd.DataFrame(out, columns=["query_id", "hit", "cached_id"]).astype({"cached_id": "Int64"})

    def close(self) -> None:
        return


def stream_semantic_cache(queries: DataFrame, least: float = 0.95, ttl_ms: int = 3_600_000) -> DataFrame:
    """(query_id, hit, cached_id) of a stream of (organization, repository, query_id, embedding)."""
    return queries.groupBy("organization", "repository").transformWithStateInPandas(SemanticCache(least, ttl_ms), "query_id long, hit boolean, cached_id long", "append", "processingTime")


class Heartbeats(StatefulProcessor):
    """Marks a worker stalled once event time passes its last beat by the timeout."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(_ms(x) for part in rows for x in part["beat"])
        if self.last.exists():
            newest = max(newest, self.last.get()[0])
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        self.last.update((newest,))
        self.handle.registerTimer(newest + STALL_SECONDS * 1000)
        yield pd.DataFrame(columns=["worker", "last_beat"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"worker": [key[0]], "last_beat": [at]})

    def close(self) -> None:
        return


def heartbeat_timeout(beats: DataFrame) -> DataFrame:
    """(worker, last_beat in ms) of workers without a beat for five minutes of event time, from a stream (worker, beat)."""
    marked = beats.withWatermark("beat", "0 seconds")
    return marked.groupBy("worker").transformWithStateInPandas(Heartbeats(), "worker long, last_beat long", "append", "eventTime")


class JobWatch(StatefulProcessor):
    """One verdict on each run of beats: stalled when none came for STALL_SECONDS, cut loose when it lasts MOST_WORK_SECONDS.

    The beat timer starts anew with each beat; the work timer stands from the run's first beat on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "start long, last long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = sorted(_ms(x) for part in rows for x in part["beat"])
        start, last, done = self.run.get() if self.run.exists() else (beats[0], beats[0], False)
        out = []
        for at in beats:
            if at - last > STALL_SECONDS * 1000:
                out += [] if done else [verdict(key[0], start, last)]
                start, done = at, False
            last = max(last, at)
            if not done and last > start + MOST_WORK_SECONDS * 1000:
                out, done = [*out, verdict(key[0], start, last)], True
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.run.update((start, last, done))
        self.handle.registerTimer(last + STALL_SECONDS * 1000 + 1)
        if not done:
            self.handle.registerTimer(start + MOST_WORK_SECONDS * 1000)
        yield pd.DataFrame(out, columns=["worker", "started", "verdict", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.run.exists():
            start, last, done = self.run.get()
            over = expiredTimerInfo.getExpiryTimeInMs() > last + STALL_SECONDS * 1000
            if not done and (over or last + STALL_SECONDS * 1000 > start + MOST_WORK_SECONDS * 1000):
                out, done = [verdict(key[0], start, last)], True
            self.run.clear() if over else self.run.update((start, last, done))
        yield pd.DataFrame(out, columns=["worker", "started", "verdict", "at"])

    def close(self) -> None:
        return


def verdict(worker, start: int, last: int) -> tuple:
    """(worker, start, stalled or cut_loose, when), in ms."""
    stalled, cut = last + STALL_SECONDS * 1000, start + MOST_WORK_SECONDS * 1000
    return (worker, start, "cut_loose", cut) if cut < stalled else (worker, start, "stalled", stalled)


def job_watch(beats: DataFrame) -> DataFrame:
    """(worker, started, verdict, at), times in ms, from a stream (worker, beat): a verdict for each run of beats less than STALL_SECONDS apart, once event time has reached it."""
    marked = beats.filter("worker IS NOT NULL AND beat IS NOT NULL").withWatermark("beat", "0 seconds")
    return marked.groupBy("worker").transformWithStateInPandas(JobWatch(), "worker long, started long, verdict string, at long", "append", "eventTime")
