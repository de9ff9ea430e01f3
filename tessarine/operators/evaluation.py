"""Evaluation of retrieval runs, decision rules and the chunk census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessarine.functions.expr import path_matches, symbol_matches
from tessarine.shared import materialize

EPS = 1e-9


def answer_ranks(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(question_id, file_rank, symbol_rank): the first result in the expected file, and the first that is the symbol there."""
    j = questions.join(results, "question_id", "left")
    in_file = path_matches(F.col("path"), F.col("expected_path"))
    is_symbol = in_file & symbol_matches(F.col("breadcrumb"), F.col("expected_symbol"))
    return j.groupBy("question_id").agg(F.min(F.when(in_file, F.col("rank"))).alias("file_rank"), F.min(F.when(is_symbol, F.col("rank"))).alias("symbol_rank"))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def recall_rank1_mrr(ranks: DataFrame, by: list[str], rank: str = "rank", k: int | None = None) -> DataFrame:
    """questions, found, first and mrr of each group; ranks beyond ``k`` and nulls count as misses."""
    r = F.col(rank) if k is None else F.when(F.col(rank) <= k, F.col(rank))
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), F.count(r).alias("found"), F.count_if(r == 1).alias("first"), F.round(F.avg(reciprocal(r)), 9).alias("mrr"))


def metric_table(ranks: DataFrame) -> DataFrame:
    """(corpus, set, level, metric, value) of (corpus, set, level, rank), with corpus ``pooled`` over all."""
    g = ranks.rollup("set", "level", "corpus").agg(F.count(F.lit(1)).cast("double").alias("questions"), F.count("rank").cast("double").alias("found"), F.round(F.avg(reciprocal(F.col("rank"))), 9).alias("mrr"), F.grouping("corpus").alias("gc"), F.grouping("level").alias("gl"))
    whole = g.filter("gl = 0").withColumn("corpus", F.when(F.col("gc") == 1, "pooled").otherwise(F.col("corpus"))).drop("gc", "gl")
    return whole.unpivot(["corpus", "set", "level"], ["questions", "found", "mrr"], "metric", "value")


def regressions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``was``, ``now`` and ``fell``: the number went down, or is gone."""
    j = before.withColumnRenamed("value", "was").join(after.withColumnRenamed("value", "now"), keys, "full")
    return j.withColumn("fell", F.coalesce(F.col("now") < F.col("was") - EPS, F.col("was").isNotNull()))


def rank_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question_id, move): worsened, improved or same; a miss is the worst rank."""
    j = before.select("question_id", F.col("rank").alias("b")).join(after.select("question_id", F.col("rank").alias("a")), "question_id")
    far = F.lit(2**31)
    b, a = F.coalesce("b", far), F.coalesce("a", far)
    return j.select("question_id", F.when(a > b, "worsened").when(a < b, "improved").otherwise("same").alias("move"))


def recompute_consistency(legs: DataFrame, fused: DataFrame, k: int = 60, tol: float = 1e-6, top: int = 5) -> DataFrame:
    """(query_id, chunk_id, problem) of recorded rows (query_id, chunk_id, rrf_score, boost_multiplier, boosted_score, rank; rank is null below the cut).

    missing: legs and record don't hold the same rows. fused: the score isn't what the legs' ranks give. boosted: it isn't
    score times multiplier. order: a row stands behind one of a smaller score. top: a rank beyond ``top``, or a row
    without one that scores above the last ranked, or though fewer than ``top`` are ranked. The first that holds is given.
    """
    again = legs.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))
    every = Window.partitionBy("query_id")
    score = F.col("boosted_score")
    before = F.min(score).over(every.orderBy(F.asc_nulls_last("rank"), F.desc("boosted_score")).rowsBetween(Window.unboundedPreceding, -1))
    placed = fused.withColumns({"_before": before, "_ranked": F.count("rank").over(every), "_last": F.min(F.when(F.col("rank").isNotNull(), score)).over(every)})
    j = placed.join(again, ["query_id", "chunk_id"], "full")
    problem = F.when(F.col("rrf").isNull() | F.col("rrf_score").isNull(), "missing").when(F.abs(F.col("rrf") - F.col("rrf_score")) > tol, "fused").when(F.abs(F.col("rrf_score") * F.col("boost_multiplier") - score) > tol, "boosted")
    problem = problem.when(F.col("rank").isNotNull() & (score - F.col("_before") > tol), "order")
    problem = problem.when((F.col("rank") > top) | (F.col("rank").isNull() & ((F.col("_ranked") < top) | (score - F.col("_last") > tol))), "top")
    return j.select("query_id", "chunk_id", problem.alias("problem")).filter("problem is not null")


def tie_groups(ranking: DataFrame, tol: float) -> DataFrame:
    """``ranking`` with ``tie``: neighbours by rank whose scores differ by at most ``tol`` share a group."""
    w = Window.partitionBy("query_id").orderBy("rank")
    gap = F.coalesce((F.lag("score").over(w) - F.col("score") > tol).cast("int"), F.lit(0))
    return ranking.withColumn("_g", gap).withColumn("tie", F.sum("_g").over(w)).drop("_g")


def rankings_agree(left: DataFrame, right: DataFrame, tol: float = 2e-6) -> DataFrame:
    """(query_id, missing, reversed, drifted, agrees) of two rankings (query_id, chunk_id, rank, score).

    Chunks of the last tie group may differ, since the cut falls into it. Pairs are compared within one query's ranking.
    """
    a, b = tie_groups(left, tol), tie_groups(right, tol)
    last = a.groupBy("query_id").agg(F.max("tie").alias("last"))
    j = a.join(b.select("query_id", "chunk_id", F.col("rank").alias("r2"), F.col("score").alias("s2"), F.col("tie").alias("t2")), ["query_id", "chunk_id"], "full").join(last, "query_id", "left")
    lost = (F.col("rank").isNull() | F.col("r2").isNull()) & (F.coalesce("tie", "last") < F.col("last"))
    one = j.groupBy("query_id").agg(F.count_if(lost).alias("missing"), F.count_if(F.abs(F.col("score") - F.col("s2")) > tol).alias("drifted"))
    m = j.filter("rank is not null and r2 is not null").select("query_id", "chunk_id", "rank", "r2", "tie", "t2")
    pairs = m.alias("x").join(m.alias("y"), (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.rank") < F.col("y.rank")) & (F.col("x.r2") > F.col("y.r2")) & (F.col("x.tie") != F.col("y.tie")) & (F.col("x.t2") != F.col("y.t2")))
    turned = pairs.groupBy(F.col("x.query_id").alias("query_id")).agg(F.count(F.lit(1)).alias("reversed"))
    out = one.join(turned, "query_id", "left").na.fill(0, ["reversed"])
    return out.withColumn("agrees", (F.col("missing") == 0) & (F.col("reversed") == 0) & (F.col("drifted") == 0))


def classify_differences(agreement: DataFrame, order_only: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, class): same, c (only the order within ties differs), a or b by the stores' evidence, else UNEXPLAINED."""
    j = agreement.join(order_only, "query_id", "left").join(evidence, "query_id", "left")
    kind = F.when(F.col("agrees") & ~F.coalesce("order_differs", F.lit(False)), "same").when(F.col("agrees"), "c").when(F.col("evidence").isin("a", "b"), F.col("evidence")).otherwise("UNEXPLAINED")
    return j.select("query_id", kind.alias("class"))


def score_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    j = left.join(right.select("query_id", "chunk_id", F.col("score").alias("s2")), ["query_id", "chunk_id"])
    return j.agg(F.count(F.lit(1)).alias("compared"), F.round(F.max(F.abs(F.col("score") - F.col("s2"))), 6).alias("drift"))


def mrr_at_depth(ranks: DataFrame, rows: DataFrame, depth: int = 20) -> DataFrame:
    """mrr at ``depth`` over (question_id, rank); null when a question's ranking (question_id, n) is shorter."""
    j = ranks.join(rows, "question_id", "left")
    within = F.when(F.col("rank") <= depth, F.col("rank"))
    return j.agg(F.when(F.min(F.coalesce("n", F.lit(0))) >= depth, F.round(F.avg(reciprocal(within)), 9)).alias("mrr"))


def ties_at_cut(ranking: DataFrame, k: int, tol: float = 2e-6) -> DataFrame:
    """(query_id, first, last): ranks of the rows within ``tol`` of the row at k, where that group reaches past k."""
    at = F.max(F.when(F.col("rank") == k, F.col("score"))).over(Window.partitionBy("query_id"))
    near = ranking.withColumn("_at", at).filter(F.abs(F.col("score") - F.col("_at")) <= tol)
    return near.groupBy("query_id").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).filter(F.col("last") > k)


def evaluate_rule(clauses: DataFrame, deltas: DataFrame, allowance: float = 0.0) -> DataFrame:
    """(rule, verdict): ADOPT when every clause holds on each of its deltas. A clause without deltas fails."""
    holds = F.coalesce(F.col("delta") >= F.col("min_delta") - allowance, F.lit(False))
    j = clauses.join(deltas, ["level", "scope"], "left")
    return j.groupBy("rule").agg(F.when(F.min(holds), "ADOPT").otherwise("REJECT").alias("verdict"))


def chained_rule(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(rule, arm): the arm to compare with, by another rule's verdict."""
    v = verdicts.select(F.col("rule").alias("depends_on"), "verdict")
    return rules.join(v, "depends_on", "left").select("rule", F.when(F.col("verdict") == "ADOPT", F.col("adopted_arm")).otherwise(F.col("base_arm")).alias("arm"))


BLOCK_IDS, TASK_PAIRS = 1024, 48
"""Ids to a block of ``target_overlap``, and pairs of blocks to a task: at most 50 million rows, of ids that fit a dictionary of Parquet."""


def target_overlap(questions: DataFrame, decision_sets: tuple[str, ...]) -> DataFrame:
    """(a, b): pairs of questions of one file with the same answer, one of them in a decision set.

    Symbols that match end in the same name, so only questions of one file and last name meet. Questions of one file, symbol
    and kind of set are cut into sorted blocks of ids; blocks meet, are dealt to tasks pair by pair, and only there become rows.
    A pair of blocks is at most BLOCK_IDS squared rows, and repeats short runs of ids, which Parquet stores in few bytes.
    Generated code keeps all rows that it makes of one row before the next step takes any: the coalesce, which merges nothing, ends it
    between the two explodes, so that a task holds the rows of one id and a block, not those of two blocks.
    """
    kind = ["path", "symbol", "decides"]
    q = questions.filter(F.col("id").isNotNull() & F.col("path").isNotNull() & F.col("symbol").isNotNull()).select("id", "path", "symbol", F.coalesce(F.col("set").isin(*decision_sets), F.lit(False)).alias("decides"))
    dealt = q.repartitionByRange(*kind, "id").sortWithinPartitions(*kind, "id").withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_IDS))
    blocks = dealt.groupBy(*kind, "block").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("last", F.substring_index("symbol", ".", -1)).drop("block")
    blocks = materialize(blocks, "blocks")
    others = blocks.toDF("path", "osymbol", "odecides", "oids", "last")
    same = symbol_matches(F.col("symbol"), F.col("osymbol")) | symbol_matches(F.col("osymbol"), F.col("symbol"))
    met = blocks.join(others, ["path", "last"]).filter(same & (F.col("decides") | F.col("odecides")) & (F.element_at("ids", 1) < F.element_at("oids", -1)))
    tasks = max(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.count() // TASK_PAIRS)
    spread = met.select("ids", "oids").repartition(tasks)
    return spread.select(F.explode("ids").alias("a"), "oids").coalesce(tasks).select("a", F.explode("oids").alias("b")).filter(F.col("a") < F.col("b"))


def targets_by_set(questions: DataFrame) -> DataFrame:
    return questions.select("set", "path", "symbol").distinct().orderBy("set", "path", "symbol")


def nearest_rank_percentile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """(by..., value): the element at position round-half-even(q * (n - 1)) of each group's sorted values.

    Equal values are counted before they are shuffled and sorted.
    """
    counted = df.groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*by)
    upto, n = F.sum("_rows").over(w.orderBy("value")), F.sum("_rows").over(w)
    return counted.withColumn("_upto", upto).withColumn("_n", n).filter(F.col("_upto") >= F.bround(q * (F.col("_n") - 1)) + 1).groupBy(*by).agg(F.min("value").alias("value"))


def census_counts(files: DataFrame, *by: str) -> DataFrame:
    """Files, characters and lines of (content) for each group."""
    lines = F.size(F.split("content", "\n"))
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("chars"), F.sum(lines).alias("lines"))


def size_histogram(chunks: DataFrame, *by: str, over: tuple[int, ...] = (2000, 5000, 8000)) -> DataFrame:
    """For each group, how many chunks have more than so many characters, and the characters of the largest."""
    chars = F.length("content")
    return chunks.groupBy(*by).agg(*(F.count_if(chars > n).alias(f"over_{n}") for n in over), F.max(chars).cast("long").alias("largest"))


def largest_chunks(chunks: DataFrame, n: int = 5) -> DataFrame:
    """(path, start_line, chars) of the n longest chunks."""
    sized = chunks.select("path", "start_line", F.length("content").cast("long").alias("chars"))
    return sized.orderBy(F.desc("chars"), "path", "start_line").limit(n)


def identical_content(chunks: DataFrame) -> DataFrame:
    """Distinct contents, chunks that share theirs, and copies beyond the first."""
    g = chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("contents"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("sharing"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


def token_billing(chunks: DataFrame, cap: int, price: float) -> DataFrame:
    """Tokens billed over distinct contents (capped), tokens cut away, truncated chunks, and the price."""
    once = chunks.dropDuplicates(["content_hash"])
    billed = once.agg(F.sum(F.least("tokens", F.lit(cap))).alias("billed"), F.sum(F.greatest(F.col("tokens") - cap, F.lit(0))).alias("cut"))
    long = chunks.agg(F.count_if(F.col("tokens") > cap).alias("truncated"))
    return billed.join(F.broadcast(long)).withColumn("cost", F.round(F.col("billed") * price / 1_000_000, 9))


def covered_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines (path, line_no) inside any span (path, start_line, end_line): spans become their lines, then a semi join."""
    inside = spans.select("path", F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))).alias("line_no")).distinct()
    return lines.join(inside, ["path", "line_no"], "left_semi")


def line_coverage(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, lines, covered, share) over non-blank lines."""
    full = lines.filter(F.trim("line") != "")
    c = covered_lines(full, spans).groupBy("path").agg(F.count(F.lit(1)).alias("covered"))
    g = full.groupBy("path").agg(F.count(F.lit(1)).alias("lines")).join(c, "path", "left").na.fill(0, ["covered"])
    return g.withColumn("share", F.round(F.col("covered") / F.col("lines"), 6))


def nested_spans(spans: DataFrame) -> DataFrame:
    """(path, nested): spans strictly inside another of their file.

    In order of rising starts and falling ends, a span is inside another when one before it ends no earlier.
    """
    places = spans.groupBy("path", "start_line", "end_line").agg(F.count_distinct("name").alias("names"))
    before = Window.partitionBy("path").orderBy("start_line", F.desc("end_line")).rowsBetween(Window.unboundedPreceding, -1)
    inside = places.withColumn("_reach", F.max("end_line").over(before)).filter(F.col("_reach") >= F.col("end_line"))
    return inside.groupBy("path").agg(F.sum("names").alias("nested"))


def class_method_coverage(lines: DataFrame, classes: DataFrame, methods: DataFrame, least: float = 0.8) -> DataFrame:
    """(path, class_name, share, well): share of a class's non-blank lines that its methods hold."""
    own = classes.select("path", "class_name", F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))).alias("line_no"))
    full = own.join(lines.filter(F.trim("line") != "").select("path", "line_no"), ["path", "line_no"])
    held = methods.select("path", "class_name", F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))).alias("line_no")).distinct().withColumn("held", F.lit(1))
    g = full.join(held, ["path", "class_name", "line_no"], "left").groupBy("path", "class_name").agg(F.round(F.count("held") / F.count(F.lit(1)), 6).alias("share"))
    return g.withColumn("well", F.col("share") >= least)


def fallback_report(chunks: DataFrame) -> DataFrame:
    """Per language: files whose chunks are all fixed-size, and all files."""
    f = chunks.groupBy("language", "path").agg(F.bool_and(F.col("chunk_type") == "fixed_size").alias("fallback"))
    return f.groupBy("language").agg(F.count_if("fallback").alias("fallback_files"), F.count(F.lit(1)).alias("files"))


def breadcrumb_collisions(chunks: DataFrame) -> DataFrame:
    g = chunks.groupBy("path", "chunk_type", "breadcrumb").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("path").agg(F.sum(F.col("n") - 1).alias("extra"))


BUCKET_DIGITS = 3
"""Hex digits of an inner key's digest that name its bucket: 4096 buckets a group."""


def multiset_digest(hashed: DataFrame, group: str, inner: str, hash_col: str = "row_hash") -> DataFrame:
    """SHA-256 per ``group`` of the sorted multiset of row hashes, in three levels.

    Rows of one inner key, then inner keys of one bucket, then a group's buckets: no array holds more than one inner
    key's rows or 1/4096 of a group's inner keys, and buckets of one group are digested by many tasks.
    """
    text = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    inner_key = F.col(inner).cast("string")
    first = hashed.groupBy(group, inner_key.alias("_inner")).agg(text(hash_col).alias("_part"))
    bucket = F.substring(F.sha2("_inner", 256), 1, BUCKET_DIGITS).alias("_bucket")
    second = first.groupBy(group, bucket).agg(text(F.concat_ws(" ", "_inner", "_part")).alias("_part"))
    return second.groupBy(group).agg(text(F.concat_ws(" ", "_bucket", "_part")).alias("digest"))


def tree_digest(files: DataFrame, group: str = "repository") -> DataFrame:
    """The digest of each group's files (path, content)."""
    return multiset_digest(files.withColumn("row_hash", F.sha2("content", 256)), group, "path")


def stored_vectors_digest(vectors: DataFrame, group: str, id_: str, embedding: str = "embedding", places: int = 6) -> DataFrame:
    """The digest of each group's stored vectors by id, each component rounded down to so many decimal places."""
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * 10**places).cast("string"))
    return multiset_digest(vectors.withColumn("row_hash", F.sha2(F.array_join(whole, ","), 256)), group, id_)


def verify_provenance(stored: DataFrame, again: DataFrame) -> DataFrame:
    """(group, version): the recorded version where the digest made again equals the stored one, else null."""
    a = again.select("repository", F.col("digest").alias("made"))
    return stored.join(a, "repository", "left").select("repository", F.when(F.col("digest") == F.col("made"), F.col("version")).alias("version"))


def decorated_definitions(marks: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line_no, held_by) of decorator lines: the chunk that starts there, an enclosing class, or nothing."""
    j = marks.join(spans, (marks.path == spans.path) & (marks.line_no >= spans.start_line) & (marks.line_no <= spans.end_line), "left").select(marks.path, marks.line_no, "kind")
    held = F.when(F.max(F.col("kind") == "function"), "own").when(F.max(F.col("kind") == "class"), "class").otherwise("none")
    return j.groupBy("path", "line_no").agg(held.alias("held_by"))
