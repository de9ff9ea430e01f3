from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


from tessarine.operators import chunking
from tessarine.sources.snapshots import ChunkSets, Conflict, LedgerSink
from tessarine.streaming import events as t
from tessarine.streaming.run import drain, drain_idle, drain_windows, scratch

DDL = "delivery_id long, event string, installation long, received_at timestamp, outcome string"


def stream_of(spark, tmp_path, rows, ddl, keys):
    """One file for each row, read one file at a time."""
    for i, row in enumerate(rows):
        (tmp_path / f"{i:03}.json").write_text(json.dumps(dict(zip(keys, row, strict=True))))
        os.utime(tmp_path / f"{i:03}.json", (1_700_000_000 + i,) * 2)  # files are taken in the order of their times
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(tmp_path))


def test_late_repeats_are_dropped(spark, tmp_path):
    rows = [(1, "push", 1, "2024-01-01T00:00:00", ""), (2, "push", 1, "2024-01-02T00:00:00", ""), (1, "push", 1, "2024-01-20T00:00:00", "")]
    got = drain(t.dedupe_deliveries(stream_of(spark, tmp_path, rows, DDL, ("delivery_id", "event", "installation", "received_at", "outcome"))))
    assert sorted(r.delivery_id for r in got.collect()) == [1, 2]


def test_push_to_jobs(spark, tmp_path):
    rows = [(1, "push", 7, "2024-01-01T00:00:00", ""), (2, "push", 8, "2024-01-01T00:00:01", ""), (3, "push", 7, "2024-01-01T00:00:02", "")]
    index = spark.createDataFrame([(7, 1, 70)], "installation long, organization long, repository_id long")
    live = spark.createDataFrame([], "repository_id long, job_id long, state string, needs_rerun boolean")
    out = []
    q = t.push_to_jobs(stream_of(spark, tmp_path, rows, DDL, ("delivery_id", "event", "installation", "received_at", "outcome")), index, lambda: live, lambda df, n: out.append([(r.repository_id, r.action) for r in df.collect()]))
    run = q.option("checkpointLocation", scratch(spark, "push")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [x for x in out if x] == [[(70, "insert")], [(70, "insert")]]


def test_stream_chunks(spark, tmp_path):
    """An unchanged file is not chunked again, a changed one replaces its chunks, an emptied one loses them; what comes after expiry counts as new."""
    rows = [("a.py", "x\ny", "2024-01-01T00:00:00"), ("b.py", "p", "2024-01-01T00:00:01"), ("a.py", "x\ny", "2024-01-02T00:00:00"), ("b.py", "", "2024-01-03T00:00:00"), ("a.py", "x\ny\nz", "2024-01-04T00:00:00"), ("a.py", "x\ny\nz", "2024-01-05T00:00:00"), ("c.py", "q", "2024-06-01T00:00:00"), ("d.py", "r", "2024-06-02T00:00:00"), ("a.py", "x\ny\nz", "2024-06-03T00:00:00")]
    sink, passed = LedgerSink(spark, str(tmp_path / "sink")), []

    def write(df, n):
        passed.extend(r.path for r in df.select("path").distinct().collect())
        sink(df.select("path", "start_line", "end_line", "arrived_at"), n)

    (tmp_path / "in").mkdir()
    chunker = lambda df: chunking.chunk_fixed(df.filter("content <> ''"))
    q = t.stream_chunks(stream_of(spark, tmp_path / "in", rows, "path string, content string, arrived_at timestamp", ("path", "content", "arrived_at")), chunker, write)
    q.option("checkpointLocation", scratch(spark, "chunks")).trigger(availableNow=True).start().awaitTermination()
    assert passed == ["a.py", "b.py", "b.py", "a.py", "c.py", "d.py", "a.py"]
    now = t.current_chunks(sink.read("path string, start_line long, end_line long, arrived_at timestamp"))
    assert sorted((r.path, r.start_line, r.end_line) for r in now.collect()) == [("a.py", 1, 3), ("c.py", 1, 1), ("d.py", 1, 1)]


def test_a_batch_that_runs_twice_leaves_one_copy(spark, tmp_path):
    sink, schema = LedgerSink(spark, str(tmp_path)), "id long"
    sink(spark.range(3), 0)
    sink(spark.range(5), 0)
    spark.range(9).write.parquet(str(tmp_path / "data" / "stream-000000000001"))  # a batch that broke off before its entry
    assert sink.read(schema).count() == 3
    sink(spark.range(2), 1)
    assert sink.read(schema).count() == 5
    LedgerSink(spark, str(tmp_path), "other")(spark.range(1), 0)
    assert sink.read(schema).count() == 6 and LedgerSink(spark, str(tmp_path / "none")).read(schema).count() == 0


SETS = "organization_id long, repository_id long, body string"


def test_chunk_sets(spark, tmp_path):
    """A reader sees old or new whole, a set replaced by nothing is empty, a lost race changes nothing."""
    sets = ChunkSets(spark, str(tmp_path), SETS)
    assert sets.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), SETS)
    found = lambda v=None: sorted(tuple(r) for r in sets.read(v).collect())
    assert sets.replace(rows((1, 7, "a"), (1, 7, "b"), (2, 8, "c"))) == 1
    old = sets.read()
    assert sets.replace(rows((1, 7, "n"))) == 2
    assert sorted(r.body for r in old.collect()) == ["a", "b", "c"] and found() == [(1, 7, "n"), (2, 8, "c")] and found(1) == [(1, 7, "a"), (1, 7, "b"), (2, 8, "c")]
    sets.replace(rows(), rows((2, 8, None)))
    assert found() == [(1, 7, "n")]
    other = ChunkSets(spark, str(tmp_path), SETS)
    other.version = lambda: 2  # read before the last commit
    with pytest.raises(Conflict):
        other.replace(rows((1, 7, "lost")))
    assert found() == [(1, 7, "n")] and sets.version() == 3
    assert len(sets.vacuum()) == 1 and found() == [(1, 7, "n")]


def test_job_watch(spark, tmp_path):
    """Stalled after five minutes without a beat, cut loose after two hours of beats; one verdict for each run, in files of any size."""
    at = lambda m: f"2024-01-01T{m // 60:02}:{m % 60:02}:00"
    beats = [(1, m) for m in range(0, 200, 4)] + [(2, 0), (2, 3), (2, 20), (2, 22)] + [(3, m) for m in range(0, 117, 4)] + [(4, 230)]
    rows = [(w, at(m)) for w, m in sorted(beats, key=lambda b: b[1])]
    zero = 1_704_067_200_000
    want = {(1, 0, "cut_loose", 120), (2, 0, "stalled", 8), (2, 20, "stalled", 27), (3, 0, "cut_loose" if 116 + 5 > 120 else "stalled", 120)}
    for size in (1, len(rows)):
        folder = tmp_path / str(size)
        folder.mkdir()
        for i in range(0, len(rows), max(1, size if size > 1 else 12)):
            part = rows[i : i + (size if size > 1 else 12)]
            (folder / f"{i:03}.json").write_text("\n".join(json.dumps({"worker": w, "beat": b}) for w, b in part))
            os.utime(folder / f"{i:03}.json", (1_700_000_000 + i,) * 2)
        stream = spark.readStream.schema("worker long, beat timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
        got = {(r.worker, (r.started - zero) // 60_000, r.verdict, (r.at - zero) // 60_000) for r in drain(t.job_watch(stream)).collect()}
        assert got == want


def test_final_windows(spark, tmp_path):
    """A window comes out once, when it is closed; a row that comes later is counted as late."""
    rows = [("push", "2024-01-01T00:10:00"), ("push", "2024-01-01T01:05:00"), ("push", "2024-01-01T00:57:00"), ("push", "2024-01-01T02:30:00"), ("push", "2024-01-01T02:40:00"), ("push", "2024-01-01T00:20:00")]
    stream = stream_of(spark, tmp_path, rows, "event string, received_at timestamp", ("event", "received_at"))
    got, late = drain_windows(t.outcome_counts(stream))
    assert {(r.window_start.hour, r.n) for r in got.collect()} == {(0, 2), (1, 1)} and late == 1


def test_semantic_cache(spark, tmp_path):
    """Queries in order of id are answered by the nearest earlier miss of their scope."""
    rng = np.random.default_rng(5)
    rows = [(i % 2, "r", i, rng.normal(size=6).tolist()) for i in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("organization", "repository", "query_id", "embedding"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("organization long, repository string, query_id long, embedding array<double>").json(str(tmp_path / "in"))
    want, known = {}, {0: [], 1: []}
    for org, _, i, v in rows:
        unit = np.array(v) / np.linalg.norm(v)
        best = max(((float(unit @ w), -k) for k, w in known[org]), default=(0.0, 0))
        want[i] = -best[1] if best[0] >= 0.6 else None
        if want[i] is None:
            known[org].append((i, unit))
    got = drain_idle(t.stream_semantic_cache(stream, 0.6)).collect()
    assert {r.query_id: r.cached_id for r in got} == want and all(r.hit == (r.cached_id is not None) for r in got) and any(r.hit for r in got)


def test_udtf_is_the_fold(spark):
    chunking.register_udtf(spark)
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["", " ", "x", f"l{i}"]) for i in range(rng.randrange(90))) for _ in range(60)]
    df = spark.createDataFrame([(str(i), text) for i, text in enumerate(texts)], "path string, content string")
    df.createOrReplaceTempView("udtf_files")
    got = sorted(tuple(r) for r in spark.sql("SELECT path, c.* FROM udtf_files, LATERAL chunk_fixed(content, 12, 2) c").collect())
    assert got == sorted(tuple(r) for r in chunking.chunk_fixed(df, 12, 2).select("path", "start_line", "end_line", "content").collect())


def test_batch_twins(spark):
    e = spark.createDataFrame([(1, "suspend", 1), (1, "unsuspend", 2), (2, "created", 1), (2, "deleted", 3), (2, "suspend", 2)], "installation long, action string, at long").select("installation", "action", F.col("at").cast("timestamp").alias("received_at"))
    got = {r.installation: (r.suspended_at is not None, r.uninstalled_at is not None) for r in t.installation_state(e).collect()}
    assert got == {1: (False, False), 2: (True, True)}
