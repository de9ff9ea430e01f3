"""Registered queries of evaluation. Runs: lineitem rows as results (rank by line), orders as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.operators import evaluation as e
from tessarine.plans.chunk_queries import OVERLAP, SIZE, _spans_sql, definitions, fixed
from tessarine.plans.chunk_queries import _DEFS
from tessarine.operators import retrieval as r
from tessarine.plans.retrieval_queries import HYBRID, searched
from tessarine.plans.roles import FILES, Registry, files, table

R = Registry()
col = F.col


def ranks(s, d):
    """(question_id, corpus, set, level, rank): an order's lines as ranks of its answer, with misses."""
    o = table(s, d, "orders")
    return o.select(col("o_orderkey").alias("question_id"), (col("o_custkey") % 3).cast("string").alias("corpus"), col("o_orderstatus").alias("set"), F.when(col("o_orderkey") % 2 == 0, "file").otherwise("symbol").alias("level"), F.when(col("o_orderkey") % 4 > 0, col("o_orderkey") % 9 + 1).alias("rank"))


RANKS = "SELECT o_orderkey AS question_id, CAST(o_custkey % 3 AS VARCHAR) AS corpus, o_orderstatus AS \"set\", CASE WHEN o_orderkey % 2 = 0 THEN 'file' ELSE 'symbol' END AS level, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 + 1 END AS rank FROM orders"


def ranking(s, d, shift=0.0):
    """(query_id, chunk_id, rank, score) with tied scores."""
    li = table(s, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    return li.select(col("l_orderkey").alias("query_id"), col("l_linenumber").alias("chunk_id"), col("l_linenumber").alias("rank"), F.round(1.0 / F.floor((col("l_linenumber") + 3) / 2) + shift, 9).alias("score"))


RANKING = "SELECT DISTINCT l_orderkey AS query_id, l_linenumber AS chunk_id, l_linenumber AS rank, round(1e0 / floor((l_linenumber + 3) / 2), 9) AS score FROM lineitem"
R.add(
    "e1_answer_ranks",
    lambda s, d: e.answer_ranks(
        table(s, d, "orders").select(col("o_orderkey").alias("question_id"), F.concat(F.lit("p"), (col("o_orderkey") % 10).cast("string")).alias("expected_path"), F.concat(F.lit("s"), (col("o_orderkey") % 3).cast("string")).alias("expected_symbol")),
        table(s, d, "lineitem").select(col("l_orderkey").alias("question_id"), col("l_linenumber").alias("rank"), F.concat(F.lit("x/p"), (col("l_partkey") % 10).cast("string")).alias("path"), F.concat(F.lit("k.s"), (col("l_suppkey") % 3).cast("string")).alias("breadcrumb")),
    ),
    """SELECT o_orderkey AS question_id, min(l_linenumber) FILTER (WHERE l_partkey % 10 = o_orderkey % 10) AS file_rank, min(l_linenumber) FILTER (WHERE l_partkey % 10 = o_orderkey % 10 AND l_suppkey % 3 = o_orderkey % 3) AS symbol_rank
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
_MRR = "round(avg(coalesce(1e0 / {}, 0e0)), 9)"
R.add("e2_recall_mrr", lambda s, d: e.recall_rank1_mrr(ranks(s, d), ["corpus", "set"], k=5), f"WITH r AS (SELECT *, CASE WHEN rank <= 5 THEN rank END AS r5 FROM ({RANKS})) SELECT corpus, \"set\", count(*) AS questions, count(r5) AS found, count(*) FILTER (WHERE r5 = 1) AS first, {_MRR.format('r5')} AS mrr FROM r GROUP BY 1, 2")
R.add(
    "e3_metric_table", lambda s, d: e.metric_table(ranks(s, d)),
    f"""WITH g AS (SELECT coalesce(corpus, 'pooled') AS corpus, "set", level, CAST(count(*) AS DOUBLE) AS questions, CAST(count(rank) AS DOUBLE) AS found, {_MRR.format('rank')} AS mrr FROM ({RANKS}) GROUP BY GROUPING SETS (("set", level, corpus), ("set", level)))
    SELECT corpus, "set", level, 'questions' AS metric, questions AS value FROM g UNION ALL SELECT corpus, "set", level, 'found', found FROM g UNION ALL SELECT corpus, "set", level, 'mrr', mrr FROM g""",
)


def _values(s, d, n):
    return table(s, d, "customer").filter(col("c_custkey") % n != 0).select((col("c_custkey") % 400).alias("k"), ((col("c_custkey") * n) % 17 / 17).alias("value")).groupBy("k").agg(F.round(F.max("value"), 9).alias("value"))


_VAL = "SELECT c_custkey % 400 AS k, round(max(((c_custkey * {0}) % 17) / 17e0), 9) AS value FROM customer WHERE c_custkey % {0} <> 0 GROUP BY 1"
R.add("e4_regressions", lambda s, d: e.regressions(_values(s, d, 5), _values(s, d, 7), ["k"]),
      f"SELECT coalesce(a.k, b.k) AS k, b.value AS was, a.value AS now, coalesce(a.value < b.value - 1e-9, b.value IS NOT NULL) AS fell FROM ({_VAL.format(5)}) b FULL JOIN ({_VAL.format(7)}) a ON a.k = b.k")
R.add("e5_rank_moves", lambda s, d: e.rank_moves(ranks(s, d), ranks(s, d).withColumn("rank", F.when(col("question_id") % 5 > 0, col("question_id") % 7 + 1))),
      f"WITH m AS (SELECT question_id, coalesce(rank, 99) AS b, coalesce(CASE WHEN question_id % 5 > 0 THEN question_id % 7 + 1 END, 99) AS a FROM ({RANKS})) SELECT question_id, CASE WHEN a > b THEN 'worsened' WHEN a < b THEN 'improved' ELSE 'same' END AS move FROM m")


def _recomputed(s, d):
    """A record with wrong scores, lost rows, turned ranks (every fourth query) and a lost rank (the next ones)."""
    found = searched(s, d)
    own = r.top_k(found.boosted, 10_000)
    rank = F.when(col("rank") <= 5, F.when(col("query_id") % 4 == 0, 6 - col("rank")).when((col("query_id") % 4 != 1) | (col("rank") > 1), col("rank")))
    wrong = F.when(col("chunk_id") % 9 == 0, 0.5).otherwise(col("rrf_score"))
    recorded = own.select("query_id", "chunk_id", wrong.alias("rrf_score"), "boost_multiplier", "boosted_score", rank.alias("rank")).filter("chunk_id % 13 <> 0")
    return e.recompute_consistency(found.keyword.select("query_id", "chunk_id", "rank").unionByName(found.vector.select("query_id", "chunk_id", "rank")), recorded)


R.add(
    "e6_recompute", _recomputed,
    f"""WITH {HYBRID}, l AS (SELECT query_id, chunk_id, sum(1e0 / (60 + rank)) AS rrf FROM every GROUP BY ALL),
    f AS (SELECT query_id, chunk_id, CASE WHEN chunk_id % 9 = 0 THEN 0.5e0 ELSE rrf_score END AS rrf_score, boost_multiplier, boosted_score, CASE WHEN rank > 5 THEN NULL WHEN query_id % 4 = 0 THEN 6 - rank WHEN query_id % 4 <> 1 OR rank > 1 THEN rank END AS rank FROM ordered WHERE chunk_id % 13 <> 0),
    p AS (SELECT *, min(boosted_score) OVER (PARTITION BY query_id ORDER BY rank NULLS LAST, boosted_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(rank) OVER q AS n, min(boosted_score) FILTER (WHERE rank IS NOT NULL) OVER q AS last FROM f WINDOW q AS (PARTITION BY query_id)),
    j AS (SELECT query_id, chunk_id, CASE WHEN rrf IS NULL OR rrf_score IS NULL THEN 'missing' WHEN abs(rrf - rrf_score) > 1e-6 THEN 'fused' WHEN abs(rrf_score * boost_multiplier - boosted_score) > 1e-6 THEN 'boosted'
      WHEN rank IS NOT NULL AND boosted_score - before > 1e-6 THEN 'order' WHEN rank > 5 OR rank IS NULL AND (n < 5 OR boosted_score - last > 1e-6) THEN 'top' END AS problem FROM l FULL JOIN p USING (query_id, chunk_id)) SELECT * FROM j WHERE problem IS NOT NULL""",
)
R.add("e7_rankings_agree", lambda s, d: e.rankings_agree(ranking(s, d), ranking(s, d).filter("chunk_id <> 3 or query_id % 4 > 0")),
      f"WITH r AS ({RANKING}), g AS (SELECT query_id, max(floor((rank + 3) / 2)) AS last FROM r GROUP BY 1), m AS (SELECT query_id, count(*) FILTER (WHERE chunk_id = 3 AND query_id % 4 = 0 AND last > 3) AS missing FROM r JOIN g USING (query_id) GROUP BY 1) SELECT query_id, missing, CAST(0 AS BIGINT) AS drifted, CAST(0 AS BIGINT) AS reversed, missing = 0 AS agrees FROM m")


def _classes(s, d):
    a = e.rankings_agree(ranking(s, d), ranking(s, d).filter("chunk_id <> 3 or query_id % 4 > 0"))
    o = table(s, d, "orders")
    return e.classify_differences(a, o.select(col("o_orderkey").alias("query_id"), (col("o_orderkey") % 3 == 0).alias("order_differs")), o.filter("o_orderkey % 8 = 0").select(col("o_orderkey").alias("query_id"), F.lit("a").alias("evidence")))


R.add("e8_classify_differences", _classes,
      f"WITH r AS ({RANKING}), g AS (SELECT query_id, max(floor((rank + 3) / 2)) AS last, bool_or(chunk_id = 3) AS has FROM r GROUP BY 1) SELECT query_id, CASE WHEN NOT (has AND query_id % 4 = 0 AND last > 3) THEN CASE WHEN query_id % 3 = 0 THEN 'c' ELSE 'same' END WHEN query_id % 8 = 0 THEN 'a' ELSE 'UNEXPLAINED' END AS class FROM g")
R.add("e9_score_drift", lambda s, d: e.score_drift(ranking(s, d), ranking(s, d).withColumn("score", col("score") + col("query_id") * 7 % 113 / 1000).filter("chunk_id > 1")),
      f"SELECT count(*) AS compared, round(max(abs(score - (score + query_id * 7 % 113 / 1000e0))), 6) AS drift FROM ({RANKING}) WHERE chunk_id > 1")


def _at_depths(s, d):
    """The measure at a depth that every ranking reaches, and at one that some don't."""
    rows = table(s, d, "lineitem").groupBy(col("l_orderkey").alias("question_id")).agg(F.count(F.lit(1)).alias("n"))
    own = ranks(s, d).join(rows.select("question_id"), "question_id", "left_semi")
    return e.mrr_at_depth(own, rows, 1).withColumn("depth", F.lit(1)).unionByName(e.mrr_at_depth(own, rows, 6).withColumn("depth", F.lit(6)))


R.add("e10_mrr_at_depth", _at_depths,
      f"""WITH n AS (SELECT l_orderkey AS question_id, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT rank, n FROM ({RANKS}) JOIN n USING (question_id))
      SELECT CASE WHEN min(n) >= depth THEN round(avg(coalesce(1e0 / CASE WHEN rank <= depth THEN rank END, 0e0)), 9) END AS mrr, depth FROM j, (SELECT CAST(unnest([1, 6]) AS INTEGER) AS depth) GROUP BY depth""")  # fmt: skip
R.add("e11_ties_at_cut", lambda s, d: e.ties_at_cut(ranking(s, d), 3), f"WITH r AS ({RANKING}), t AS (SELECT *, max(score) FILTER (WHERE rank = 3) OVER (PARTITION BY query_id) AS cut FROM r) SELECT query_id, min(rank) AS first, max(rank) AS last FROM t WHERE abs(score - cut) <= 2e-6 GROUP BY 1 HAVING max(rank) > 3")


def _clauses(s, d):
    n = table(s, d, "nation")
    return n.select(col("n_name").alias("rule"), F.when(col("n_nationkey") % 2 == 0, "file").otherwise("symbol").alias("level"), F.lit("pooled").alias("scope"), (col("n_nationkey") / 100).alias("min_delta"))


def _deltas(s, d):
    a = e.recall_rank1_mrr(ranks(s, d), ["level"]).select("level", F.lit("pooled").alias("scope"), (F.round(col("mrr"), 6) - 0.1).alias("delta"))
    return a


_VERDICT = f"""WITH m AS (SELECT level, round({_MRR.format('rank')}, 6) - 0.1e0 AS delta FROM ({RANKS}) GROUP BY 1) SELECT n_name AS rule, CASE WHEN delta >= n_nationkey / 100e0 THEN 'ADOPT' ELSE 'REJECT' END AS verdict, n_nationkey AS k FROM nation JOIN m ON level = CASE WHEN n_nationkey % 2 = 0 THEN 'file' ELSE 'symbol' END"""
R.add("e12_evaluate_rule", lambda s, d: e.evaluate_rule(_clauses(s, d), _deltas(s, d)), f"SELECT rule, verdict FROM ({_VERDICT})")
R.add("e13_chained_rule", lambda s, d: e.chained_rule(table(s, d, "supplier").join(table(s, d, "nation"), col("s_nationkey") == col("n_nationkey")).select(col("s_name").alias("rule"), col("n_name").alias("depends_on"), F.lit("new").alias("adopted_arm"), F.lit("old").alias("base_arm")), e.evaluate_rule(_clauses(s, d), _deltas(s, d))),
      f"SELECT s_name AS rule, CASE WHEN verdict = 'ADOPT' THEN 'new' ELSE 'old' END AS arm FROM supplier JOIN ({_VERDICT}) ON k = s_nationkey")
_Q = lambda s, d: table(s, d, "orders").select(col("o_orderkey").alias("id"), F.when(col("o_orderstatus") == "F", "holdout").otherwise("tuning").alias("set"), (col("o_custkey") % 500).cast("string").alias("path"), F.concat(F.when(col("o_orderkey") % 2 == 0, "a.").otherwise(""), F.lit("s"), (col("o_orderkey") % 4).cast("string")).alias("symbol"))
_QSQL = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'holdout' ELSE 'tuning' END AS \"set\", CAST(o_custkey % 500 AS VARCHAR) AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'a.' ELSE '' END || 's' || (o_orderkey % 4) AS symbol FROM orders"
R.add("e14_target_overlap", lambda s, d: e.target_overlap(_Q(s, d), ("holdout",)), f"WITH q AS ({_QSQL}) SELECT x.id AS a, y.id AS b FROM q x JOIN q y ON x.path = y.path AND x.id < y.id AND (x.symbol = y.symbol OR ends_with(x.symbol, '.' || y.symbol) OR ends_with(y.symbol, '.' || x.symbol)) AND (x.\"set\" = 'holdout' OR y.\"set\" = 'holdout')")
R.add("e15_targets_by_set", lambda s, d: e.targets_by_set(_Q(s, d)), f"SELECT DISTINCT \"set\", path, symbol FROM ({_QSQL})")
R.add("e16_census_counts", lambda s, d: e.census_counts(files(s, d), "lang"),
      f"SELECT lang, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM ({FILES}) GROUP BY 1")
R.add("e17_size_histogram", lambda s, d: e.size_histogram(fixed(s, d), "repository"),
      f"WITH {_spans_sql(SIZE, OVERLAP)} SELECT repository, count(*) FILTER (WHERE length(chunks.content) > 2000) AS over_2000, count(*) FILTER (WHERE length(chunks.content) > 5000) AS over_5000, count(*) FILTER (WHERE length(chunks.content) > 8000) AS over_8000, max(length(chunks.content)) AS largest FROM chunks JOIN files USING (doc_id) GROUP BY 1")
R.add("e18_percentile", lambda s, d: e.nearest_rank_percentile(table(s, d, "documents"), ["source"], "n_chars", 0.9), "WITH w AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, n_chars AS value FROM w WHERE i = round_even(0.9e0 * (n - 1), 0) + 1")


def _hashed(s, d):
    from tessarine.functions.expr import count_tokens

    return fixed(s, d).withColumn("content_hash", F.sha2("content", 256)).withColumn("tokens", count_tokens(col("content")))


R.add("e19_token_billing", lambda s, d: e.token_billing(_hashed(s, d), 300, 0.1),
      f"""WITH {_spans_sql(SIZE, OVERLAP)}, t AS (SELECT content, len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS n FROM chunks), o AS (SELECT DISTINCT content, n FROM t)
      SELECT CAST((SELECT sum(least(n, 300)) FROM o) AS BIGINT) AS billed, CAST((SELECT sum(greatest(n - 300, 0)) FROM o) AS BIGINT) AS cut, (SELECT count(*) FROM t WHERE n > 300) AS truncated, round((SELECT sum(least(n, 300)) FROM o) * 0.1e0 / 1e6, 9) AS cost""")  # fmt: skip
R.add("e20_identical_content", lambda s, d: e.identical_content(_hashed(s, d)), f"WITH {_spans_sql(SIZE, OVERLAP)}, g AS (SELECT content, count(*) AS n FROM chunks GROUP BY 1) SELECT count(*) AS contents, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS sharing, CAST(sum(n - 1) AS BIGINT) AS extra FROM g")
R.add("e21_largest_chunks", lambda s, d: e.largest_chunks(fixed(s, d)), f"WITH {_spans_sql(SIZE, OVERLAP)} SELECT path, start_line, length(content) AS chars FROM chunks ORDER BY chars DESC, path, start_line LIMIT 5")


def _lines(s, d):
    return files(s, d).select("path", F.posexplode(F.split("content", "\n")).alias("at", "line")).select("path", (col("at") + 1).cast("long").alias("line_no"), "line")


_LINES = f"l AS (SELECT path, CAST(unnest(range(1, len(a) + 1)) AS BIGINT) AS line_no, unnest(a) AS line FROM (SELECT path, string_split(content, chr(10)) AS a FROM ({FILES})))"
_SPAN = lambda s, d, a, b: files(s, d).select("path", F.concat(F.lit("c"), (col("doc_id") % 2).cast("string")).alias("class_name"), (1 + col("doc_id") % a).alias("start_line"), (2 + col("doc_id") % b).alias("end_line"))
R.add("e22_line_coverage", lambda s, d: e.line_coverage(_lines(s, d), _SPAN(s, d, 2, 5)),
      f"WITH {_LINES}, f AS ({FILES}), n AS (SELECT l.path, count(*) AS lines, count(*) FILTER (WHERE line_no BETWEEN 1 + doc_id % 2 AND greatest(1 + doc_id % 2, 2 + doc_id % 5)) AS covered FROM l JOIN f USING (path) WHERE trim(line, ' ') <> '' GROUP BY 1) SELECT path, lines, covered, round(covered / lines, 6) AS share FROM n")
R.add("e23_nested_spans", lambda s, d: e.nested_spans(definitions(s, d).distinct()), f"WITH d AS (SELECT DISTINCT * FROM ({_DEFS})) SELECT path, count(*) AS nested FROM d a WHERE EXISTS (SELECT 1 FROM d b WHERE b.path = a.path AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND (b.start_line < a.start_line OR b.end_line > a.end_line)) GROUP BY 1")
R.add("e24_class_method_coverage", lambda s, d: e.class_method_coverage(_lines(s, d), _SPAN(s, d, 2, 9), _SPAN(s, d, 3, 7)),
      f"WITH {_LINES}, f AS ({FILES}), n AS (SELECT l.path, 'c' || (doc_id % 2) AS class_name, round(count(*) FILTER (WHERE line_no BETWEEN 1 + doc_id % 3 AND greatest(1 + doc_id % 3, 2 + doc_id % 7)) / count(*), 6) AS share FROM l JOIN f USING (path) WHERE trim(line, ' ') <> '' AND line_no BETWEEN 1 + doc_id % 2 AND greatest(1 + doc_id % 2, 2 + doc_id % 9) GROUP BY 1, 2) SELECT *, share >= 0.8 AS well FROM n")
R.add("e25_fallback_report", lambda s, d: e.fallback_report(table(s, d, "lineitem").select(col("l_orderkey").alias("path"), (col("l_orderkey") % 4).alias("language"), F.when(col("l_returnflag") == "R", "function").otherwise("fixed_size").alias("chunk_type"))),
      "WITH f AS (SELECT l_orderkey % 4 AS language, l_orderkey, bool_and(l_returnflag <> 'R') AS fb FROM lineitem GROUP BY 1, 2) SELECT language, count(*) FILTER (WHERE fb) AS fallback_files, count(*) AS files FROM f GROUP BY 1")
R.add("e26_breadcrumb_collisions", lambda s, d: e.breadcrumb_collisions(table(s, d, "lineitem").select((col("l_orderkey") % 300).alias("path"), col("l_returnflag").alias("chunk_type"), col("l_shipdate").alias("breadcrumb"))),
      "WITH g AS (SELECT l_orderkey % 300 AS path, count(*) AS n FROM lineitem GROUP BY l_orderkey % 300, l_returnflag, l_shipdate) SELECT path, CAST(sum(n - 1) AS BIGINT) AS extra FROM g GROUP BY 1")


def _digest(s, d):
    return e.multiset_digest(fixed(s, d).withColumn("row_hash", F.sha2(F.concat_ws(":", F.col("start_line").cast("string"), "content"), 256)), "repository", "path")


_LEVELS = """b AS (SELECT {0}, left(sha256(k), 3) AS bucket, sha256(string_agg(k || ' ' || part, chr(10) ORDER BY k || ' ' || part)) AS part FROM p GROUP BY 1, 2)
SELECT {0}, sha256(string_agg(bucket || ' ' || part, chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY 1"""
_DIGEST = f"""WITH {_spans_sql(SIZE, OVERLAP)}, h AS (SELECT repository, path, sha256(start_line || ':' || c.content) AS r FROM (SELECT doc_id, start_line, content FROM chunks) c JOIN files USING (doc_id)),
p AS (SELECT repository, path AS k, sha256(string_agg(r, chr(10) ORDER BY r)) AS part FROM h GROUP BY repository, path), {_LEVELS.format('repository')}"""
R.add("e27_chunk_set_digest", _digest, _DIGEST)
R.add("e28_tree_digest", lambda s, d: e.tree_digest(files(s, d)), f"WITH p AS (SELECT repository, path AS k, sha256(sha256(content)) AS part FROM ({FILES})), {_LEVELS.format('repository')}")
R.add(
    "e28_stored_vectors_digest",
    lambda s, d: e.stored_vectors_digest(table(s, d, "embeddings"), "label", "vec_id"),
    f"""WITH p AS (SELECT label, CAST(vec_id AS VARCHAR) AS k, sha256(sha256(array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ','))) AS part FROM embeddings),
    {_LEVELS.format('label')}""",
)
R.add("e29_decorated_definitions", lambda s, d: e.decorated_definitions(files(s, d).select("path", (1 + col("doc_id") % 9).alias("line_no")), files(s, d).select("path", (1 + col("doc_id") % 4).alias("start_line"), (3 + col("doc_id") % 5).alias("end_line"), F.when(col("doc_id") % 2 == 0, "function").otherwise("class").alias("kind"))),
      f"SELECT path, 1 + doc_id % 9 AS line_no, CASE WHEN 1 + doc_id % 9 BETWEEN 1 + doc_id % 4 AND 3 + doc_id % 5 THEN CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE 'class' END ELSE 'none' END AS held_by FROM ({FILES})")
R.add("e30_verify_provenance", lambda s, d: e.verify_provenance(_digest(s, d).withColumn("version", F.concat(F.lit("v"), "repository")), _digest(s, d).withColumn("digest", F.when(col("repository") == "src3", "x").otherwise(col("digest")))),
      f"SELECT repository, CASE WHEN repository <> 'src3' THEN 'v' || repository END AS version FROM ({_DIGEST})")
