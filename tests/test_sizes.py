"""Steps whose rows must not grow with the square of a group, and what they give on odd inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.operators import evaluation, lineage, quality, retrieval
from tessarine.sources import files as src


def made_rows(df, *nodes):
    """The most rows that any operator of the run made whose name holds one of ``nodes``."""
    df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plans.append(plan.executedPlan())
        elif "QueryStage" in name:
            plans.append(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        if any(n in name for n in nodes) and metric.isDefined():
            most = max(most, metric.get().value())
        plans.extend(plan.children().apply(i) for i in range(plan.children().size()))
    return most


def test_find_existing_meets_one_row_of_a_key(spark):
    """A URL that 300 known rows share is met once by each of 200 asked rows; nulls match nothing."""
    known = spark.range(300).select(F.col("id").alias("repository_id"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("outer_id"), F.lit("u").alias("url"), (F.col("id") % 7).alias("created_at"))
    asked = spark.range(200).select(F.col("id").alias("ask_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("outer_id"), F.when(F.col("id") % 5 > 0, "u").alias("url"))
    found = lineage.find_existing(asked, known)
    want = {a: a if a % 6 == 0 else 7 for a in range(200) if a % 6 == 0 or a % 5 > 0}
    assert made_rows(found, "Join", "Cartesian") <= 200
    assert {r.ask_id: r.repository_id for r in found.collect()} == want


def test_resolve_user_meets_one_row_of_a_key(spark):
    users = spark.range(300).select((F.col("id") + 10).alias("user_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("identity"), F.lit("A@x").alias("email"))
    logins = spark.range(200).select(F.col("id").alias("login_id"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("identity"), F.when(F.col("id") % 5 > 0, "a@X").alias("email"))
    found = lineage.resolve_user(logins, users)
    want = {a: a + 10 if a % 6 == 0 else 10 for a in range(200) if a % 6 == 0 or a % 5 > 0}
    assert made_rows(found, "Join", "Cartesian") <= 200
    assert {r.login_id: r.user_id for r in found.collect()} == want


def test_line_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """A file for each row, in folders of bounded size that belong to one task, without checksum files, and all of them are found again."""
    monkeypatch.setattr(src, "FOLDER_FILES", 10)
    rows = spark.range(0, 95, 1, 3).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("l"), F.col("id") % 2)).alias("lang"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("ä "), F.col("id"))).alias("value"))
    src.write_line_files(rows, f"file://{tmp_path}/t/kept", "lang")
    every = [p for p in (tmp_path / "t").rglob("*") if p.is_file()]
    assert len(every) == 95 and {p.suffix for p in every} == {".txt"} and max(len(list(p.parent.iterdir())) for p in every) <= 10
    found = src.scan_source_tree(spark, f"file://{tmp_path}/t", ("kept",), (".txt",), ("lang=__HIVE",)).collect()
    assert {(r.path.split("/")[1], r.content) for r in found} == {(f"lang=l{i % 2}", f"ä {i}\n") for i in range(95) if i % 5 and i % 9}


def test_postings_are_grouped_where_texts_are_read(spark):
    """No word of a chunk is shuffled; chunks that share a key, nulls among them, are merged."""
    rows = [(1, 1, "a", "The red fox, red FOX", "x.y"), (2, 1, "a", "", None), (3, None, "a", None, "the"), (4, 1, "a", "b " * 3, "x")]
    schema = "chunk_id long, organization long, repository string, content string, breadcrumb string"
    one = retrieval.build_postings(spark.createDataFrame(rows, schema))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    want = {(1, 1, "content", "red"): [2, 4], (1, 1, "content", "fox"): [3, 5], (1, 1, "breadcrumb", "x"): [1], (1, 1, "breadcrumb", "y"): [2], (1, 4, "content", "b"): [1, 2, 3], (1, 4, "breadcrumb", "x"): [1]}
    got = lambda df: {(r.organization, r.chunk_id, r.field, r.term): r.positions for r in df.collect()}
    assert got(one) == want and one.count() == len(want)
    both = retrieval.build_postings(spark.createDataFrame([*rows, (1, 1, "a", "a red hen", None), (3, None, "a", "hen", None), (3, None, "a", "hen hen", None)], schema))
    assert got(both) == want | {(1, 1, "content", "red"): [2, 2, 4], (1, 1, "content", "hen"): [3], (None, 3, "content", "hen"): [1, 1, 2]}
    assert both.count() == len(want) + 2


def test_cover_steps_are_computed_once(spark):
    """Scores are those of a plain loop over covers, and a step makes no maps."""
    hits = [(1, "a"), (4, "b"), (5, "a"), (9, "c"), (10, "b"), (11, "a"), (20, "c"), (21, "c"), (30, "a")]
    last, start, want = {}, 0, 0.0
    for at, term in hits:
        last[term] = at
        if len(last) == 3 and min(last.values()) > start:
            start = min(last.values())
            want += 1 / (at - start + 1)
    column = F.array(*(F.struct(F.lit(at).cast("long").alias("at"), F.lit(t).alias("term")) for at, t in hits))
    df = spark.range(3).select("id", column.alias("hits")).select(retrieval.cover_density(F.col("hits"), F.lit(3)).alias("s"))
    assert "map_concat" not in df._jdf.queryExecution().analyzed().toString() and {round(r.s, 9) for r in df.collect()} == {round(want, 9)}


def test_comparable_runs_meet_in_one_join(spark):
    schema = "id long, question string, set string, vector_hash string, error string"
    before = spark.createDataFrame([(1, "q", "t", "h", None), (2, "q", "t", None, None), (3, "q", "t", "h", "e"), (3, "q", "t", "h", None)], schema)
    after = spark.createDataFrame([(1, "p", "s", "i", "e"), (2, "q", "t", None, None), (4, "q", "t", "h", None)], schema)
    found = quality.check_comparable_runs(before, after)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1
    want = [("failed", "1"), ("failed", "3"), ("missing", "3"), ("missing", "3"), ("missing", "4"), ("question", "1"), ("repeated_before", "3"), ("set", "1"), ("vector", "1"), ("vector", "2")]
    assert sorted((r.check, r.key) for r in found.collect()) == want


def test_target_overlap_meets_blocks_of_ids(spark, monkeypatch):
    """400 questions of one answer meet as blocks, not as 160,000 rows; every pair is there once, with repeated ids and nulls as in SQL."""
    monkeypatch.setattr(evaluation, "BLOCK_IDS", 50)
    i = F.col("id")
    rows = spark.range(400).select(F.when(i % 50 > 0, i - i % 7 % 2).alias("id"), F.when(i % 3 == 0, "holdout").when(i % 3 == 1, "tuning").alias("set"), F.when(i % 41 > 0, "p").alias("path"), F.when(i % 43 > 0, F.concat(F.when(i % 5 > 0, "a.").otherwise(""), F.lit("s"))).alias("symbol"))
    found = evaluation.target_overlap(rows, ("holdout",))
    own = [r for r in rows.collect() if None not in (r.id, r.path, r.symbol)]
    want = sorted((x.id, y.id) for x in own for y in own if x.id < y.id and "holdout" in (x.set, y.set))
    assert sorted((r.a, r.b) for r in found.collect()) == want and len(want) > 30_000
    assert made_rows(found, "Join", "Cartesian") <= 1000
