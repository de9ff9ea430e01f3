"""Registered queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.operators import retrieval as r
from tessarine.operators.postings import PostingsStore
from tessarine.plans.roles import DOCUMENT_VECTORS, FILES, QUESTIONS, VECTOR_CHUNKS, Registry, document_vectors, files, questions, table, vector_chunks
from tessarine.shared import work_path

R = Registry()
_STOP = r.STOP_WORDS
_TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def chunks(s, d):
    """Documents as chunks of one window, with breadcrumb and run."""
    return files(s, d).select(
        F.col("doc_id").alias("chunk_id"), "content", F.concat_ws(".", "repository", "lang").alias("breadcrumb"), F.col("path").alias("file_path"), F.lit(1).cast("long").alias("start_line"), F.size(F.split("content", "\n")).cast("long").alias("end_line"),
        F.col("lang").alias("language"), F.when(F.col("doc_id") % 3 == 0, "function").when(F.col("doc_id") % 3 == 1, "class").otherwise("docs").alias("chunk_type"), "organization", "repository", (F.col("doc_id") % 50).alias("run_id"),
    )


CHUNKS = f"""SELECT doc_id AS chunk_id, content, repository || '.' || lang AS breadcrumb, path AS file_path, CAST(1 AS BIGINT) AS start_line, CAST(len(string_split(content, chr(10))) AS BIGINT) AS end_line, lang AS language,
  CASE doc_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'docs' END AS chunk_type, organization, repository, doc_id % 50 AS run_id FROM ({FILES})"""


def runs(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("commit_sha"), F.col("o_orderdate").cast("timestamp").alias("completed_at"))


RUNS = "SELECT o_orderkey AS run_id, sha256(CAST(o_orderkey AS VARCHAR)) AS commit_sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ingestion_date FROM orders"


def vector_queries(s, d):
    return vector_chunks(s, d).filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


POSTINGS = f"""POSTINGS AS (WITH w AS (SELECT organization, repository, chunk_id, 'content' AS field, {_TERMS.format('content')} AS a FROM chunks UNION ALL SELECT organization, repository, chunk_id, 'breadcrumb', {_TERMS.format('breadcrumb')} FROM chunks),
  e AS (SELECT organization, repository, chunk_id, field, unnest(a) AS term, CAST(unnest(range(1, len(a) + 1)) AS BIGINT) AS pos FROM w) SELECT organization, repository, chunk_id, field, term, list(pos ORDER BY pos) AS positions FROM e WHERE term NOT IN {_STOP} GROUP BY ALL)"""
MATCHED = f"""asked AS (SELECT organization, repository, query_id, n, unnest(w) AS term FROM (SELECT organization, repository, query_id, w, len(w) AS n FROM (SELECT organization, repository, query_id, list_distinct(list_filter({_TERMS.format('query')}, lambda t: t NOT IN {_STOP})) AS w FROM questions))),
met AS (SELECT query_id, chunk_id, field, n, p.term, positions FROM POSTINGS p JOIN asked a ON p.term = a.term AND p.organization = a.organization AND p.repository = a.repository),
full_ AS (SELECT query_id, chunk_id, field, n FROM met GROUP BY ALL HAVING count(*) = n),
hits AS (SELECT query_id, chunk_id, field, n, term, unnest(positions) AS pos FROM met JOIN full_ USING (query_id, chunk_id, field, n))"""
#: A cover ends at a hit; its start is the least over terms of their latest place up to there; a start counts at its first end.
COVERS = """covers AS (SELECT e.query_id, e.chunk_id, e.field, e.n, e.pos AS stop, h.term, max(h.pos) AS latest FROM hits e JOIN hits h ON e.query_id = h.query_id AND e.chunk_id = h.chunk_id AND e.field = h.field AND h.pos <= e.pos GROUP BY ALL),
starts AS (SELECT query_id, chunk_id, field, stop, min(latest) AS start FROM covers GROUP BY query_id, chunk_id, field, n, stop HAVING count(*) = n),
least_ AS (SELECT query_id, chunk_id, field, start, min(stop) AS stop FROM starts GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(max(s), 6) AS score FROM (SELECT query_id, chunk_id, field, sum(1e0 / (stop - start + 1)) AS s FROM least_ GROUP BY ALL) GROUP BY ALL),
keyword AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 50)"""
KEYWORD = f"questions AS ({QUESTIONS}), chunks AS ({CHUNKS}), {POSTINGS}, {MATCHED}, {COVERS}"
VECTOR = f"""vchunks AS ({VECTOR_CHUNKS}), vscores AS (SELECT q.chunk_id AS query_id, c.chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM vchunks c JOIN vchunks q
  ON q.chunk_id % 20 = 0 AND c.organization = q.organization AND c.repository = q.repository AND c.model = q.model AND c.chunk_id <> q.chunk_id),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vscores) WHERE rank <= 50)"""


def keyword(s, d):
    return r.keyword_leg(chunks(s, d), questions(s, d))


def stored_keyword(s, d):
    """The keyword leg over postings that were written first, as a later job would read them."""
    store = PostingsStore(s, work_path(s, "postings"))
    store.write(chunks(s, d))
    return store.keyword_leg(questions(s, d))


def question_vectors(s, d):
    """A question has its item's vector, in the question's own scope."""
    own = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.lit(0).alias("model"), "embedding")
    return questions(s, d).select("query_id", "organization", "repository", F.floor(F.col("query_id") / 10000).alias("item_id")).join(own, "item_id").drop("item_id")


QVECTOR = f"""dvectors AS ({DOCUMENT_VECTORS}), qvectors AS (SELECT query_id, organization, repository, embedding FROM questions JOIN embeddings ON vec_id = query_id // 10000),
vscores AS (SELECT query_id, chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM dvectors c JOIN qvectors q
  ON c.organization = q.organization AND c.repository = q.repository AND c.chunk_id <> q.query_id),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vscores) WHERE rank <= 50)"""
FUSED = """every AS (SELECT query_id, chunk_id, rank, 'fts' AS source, 0 AS leg FROM keyword UNION ALL SELECT query_id, chunk_id, rank, 'vector', 1 FROM vector),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, leg, best, chunk_id) AS fused_rank FROM
  (SELECT query_id, chunk_id, round(sum(1e0 / (60 + rank)), 9) AS rrf_score, string_agg(source, ',' ORDER BY source) AS sources, min(leg) AS leg, arg_min(rank, leg) AS best FROM every GROUP BY query_id, chunk_id))"""
CONFIG = {"chunk_type_boosts": {"docs": 1.5}, "breadcrumb_match_boost": 1.2}
BOOSTED = r"""boosted AS (SELECT f.*, chunk_type, chunks.repository, content, breadcrumb, file_path, start_line, end_line, language, run_id, CASE WHEN chunk_type = 'docs' THEN 1.5e0 ELSE 1e0 END * CASE WHEN regexp_matches(file_path, '^((.*/)?(node_modules|vendor|dist|build|migrations|__pycache__|\.git)/.*|.*\.lock$|.*-lock\.json$)') THEN 0.3e0 ELSE 1e0 END
  * CASE WHEN len(list_filter(regexp_extract_all(query, '\b[a-z_][a-z0-9_]{2,}\b'), lambda i: contains(lower(breadcrumb), i))) > 0 THEN 1.2e0 ELSE 1e0 END AS boost_multiplier FROM fused f JOIN chunks USING (chunk_id) JOIN questions USING (query_id)),
ordered AS (SELECT *, round(rrf_score * boost_multiplier, 12) AS boosted_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score * boost_multiplier, 12) DESC, fused_rank) AS rank FROM boosted)"""
HYBRID = f"{KEYWORD}, {QVECTOR}, {FUSED}, {BOOSTED}"


def searched(s, d):
    return r.Search(questions(s, d), chunks(s, d), document_vectors(s, d), question_vectors(s, d), CONFIG, content_boosts=False)


def boosted(s, d):
    return searched(s, d).boosted


R.add("r1_postings", lambda s, d: r.build_postings(chunks(s, d)).select("organization", "repository", "chunk_id", "field", "term", F.array_join("positions", ",").alias("positions")), f"WITH chunks AS ({CHUNKS}), {POSTINGS} SELECT organization, repository, chunk_id, field, term, array_to_string(positions, ',') AS positions FROM POSTINGS")
R.add("r2_keyword_match", lambda s, d: r.keyword_match(r.build_postings(chunks(s, d)), questions(s, d)).select("query_id", "chunk_id", "field"), f"WITH questions AS ({QUESTIONS}), chunks AS ({CHUNKS}), {POSTINGS}, {MATCHED} SELECT query_id, chunk_id, field FROM full_")
R.add("r3_cover_density", lambda s, d: keyword(s, d).select("query_id", "chunk_id", "score"), f"WITH {KEYWORD} SELECT query_id, chunk_id, score FROM keyword")
R.add("r4_keyword_leg", stored_keyword, f"WITH {KEYWORD} SELECT query_id, chunk_id, score, rank FROM keyword")
R.add("r5_vector_leg", lambda s, d: r.vector_leg(vector_chunks(s, d), vector_queries(s, d)), f"WITH {VECTOR} SELECT query_id, chunk_id, score, rank FROM vector")
R.add("r6_vector_leg_approx", lambda s, d: r.vector_leg_approx(vector_chunks(s, d), vector_queries(s, d)))
R.add(
    "r7_tie_tail",
    lambda s, d: r.exact_with_tie_tail(r.vector_heaps(vector_chunks(s, d), vector_queries(s, d), 5, tol=0.02), 5, 0.02),
    f"WITH {VECTOR}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vscores), l AS (SELECT *, max(score) FILTER (WHERE rank = 5) OVER (PARTITION BY query_id) AS last FROM t) SELECT query_id, chunk_id, score, rank FROM l WHERE rank <= 5 OR last - score <= 0.02e0",
)
R.add("r8_rrf_fuse", lambda s, d: searched(s, d).fused, f"WITH {KEYWORD}, {QVECTOR}, {FUSED} SELECT query_id, chunk_id, rrf_score, sources, fused_rank FROM fused")
R.add("r9_metadata_boost", lambda s, d: boosted(s, d).select("query_id", "chunk_id", "boost_multiplier", "boosted_score"), f"WITH {HYBRID} SELECT query_id, chunk_id, boost_multiplier, boosted_score FROM ordered")
R.add("r10_top_k", lambda s, d: r.top_k(boosted(s, d), 5).select("query_id", "rank", "chunk_id", "boosted_score"), f"WITH {HYBRID} SELECT query_id, rank, chunk_id, boosted_score FROM ordered WHERE rank <= 5")
_RICH = "query_id, rank, chunk_id, rrf_score, boost_multiplier, boosted_score, sources, file_path, start_line, end_line, left(content, 200) AS preview, breadcrumb, language, chunk_type, o.run_id AS run_id, coalesce(commit_sha, '') AS commit_sha, coalesce(ingestion_date, '') AS ingestion_date"
for _n in ("r11_enrich", "r12_hybrid_search"):
    R.add(_n, (lambda s, d: searched(s, d).results(runs(s, d), 5)) if _n.startswith("r12") else (lambda s, d: searched(s, d).results(runs(s, d), 10)), f"WITH {HYBRID}, runs AS ({RUNS}) SELECT {_RICH} FROM ordered o LEFT JOIN runs ON o.run_id = runs.run_id WHERE rank <= {5 if _n.startswith('r12') else 10}")
R.add(
    "r13_search_trace",
    lambda s, d: searched(s, d).trace(5),
    f"WITH {HYBRID} SELECT query_id, 'fts' AS stage, rank, chunk_id, score FROM keyword UNION ALL SELECT query_id, 'vector', rank, chunk_id, score FROM vector UNION ALL SELECT query_id, 'fused', fused_rank, chunk_id, rrf_score FROM fused UNION ALL SELECT query_id, 'top', rank, chunk_id, boosted_score FROM ordered WHERE rank <= 5",
)
R.add(
    "r14_search_stats",
    lambda s, d: searched(s, d).stats(),
    f"WITH {KEYWORD}, {QVECTOR}, {FUSED} SELECT query_id, (SELECT count(*) FROM keyword k WHERE k.query_id = q.query_id) AS fts_rows, (SELECT count(*) FROM vector v WHERE v.query_id = q.query_id) AS vector_rows, (SELECT count(*) FROM fused f WHERE f.query_id = q.query_id) AS fused_rows FROM questions q",
)


def _ranked_docs(s, d):
    """The ten best chunks of every question."""
    return r.top_k(boosted(s, d), 10).select("query_id", "rank", "chunk_id", "content", "file_path", "start_line", "breadcrumb")


_RANKED = f"{HYBRID}, ranked AS (SELECT * FROM ordered WHERE rank <= 10)"
R.add(
    "r15_build_context",
    lambda s, d: r.build_context(_ranked_docs(s, d)),
    f"""WITH {_RANKED} SELECT query_id, string_agg('[' || rank || '] ' || file_path || ':' || start_line || ' (' || breadcrumb || ')' || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10), chr(10) ORDER BY rank) AS context, string_agg(rank || ':' || file_path, ',' ORDER BY rank) AS sources FROM ranked GROUP BY query_id""",
)
R.add(
    "r16_fit_budget",
    lambda s, d: r.fit_budget(_ranked_docs(s, d), 4000, 120).select("query_id", "rank", "chunk_id", "tokens", "running"),
    f"WITH {_RANKED}, t AS (SELECT *, CAST(len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS BIGINT) AS tokens FROM ranked), w AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) + 120 AS BIGINT) AS running FROM t) SELECT query_id, rank, chunk_id, tokens, running FROM w WHERE running <= 4000",
)
R.add(
    "r17_no_answer",
    lambda s, d: r.no_answer(questions(s, d), questions(s, d).filter("query_id % 3 = 0").select("query_id", F.col("query").alias("answer"), F.lit(0.5).alias("total_cost"))),
    f"WITH q AS ({QUESTIONS}) SELECT query_id, CASE WHEN query_id % 3 = 0 THEN query ELSE '{r.NO_ANSWER.replace(chr(39), chr(39) * 2)}' END AS answer, CASE WHEN query_id % 3 = 0 THEN 0.5e0 ELSE 0e0 END AS total_cost FROM q",
)


def _cache(s, d):
    at = F.timestamp_add("MINUTE", F.col("vec_id").cast("int") % 120, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(s, d, "embeddings").select(F.col("vec_id").alias("cached_id"), (F.col("label") % 2).cast("long").alias("organization"), F.col("label").cast("string").alias("repository"), "embedding", at.alias("cached_at"), F.concat(F.lit("q"), (F.col("vec_id") % 40).cast("string")).alias("query"), F.col("vec_id").cast("string").alias("response"))


_CACHE = "SELECT vec_id AS cached_id, CAST(label % 2 AS BIGINT) AS organization, CAST(label AS VARCHAR) AS repository, embedding, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (vec_id % 120) AS cached_at, 'q' || (vec_id % 40) AS query, CAST(vec_id AS VARCHAR) AS response FROM embeddings"
R.add(
    "r18_cache_lookup",
    lambda s, d: r.cache_lookup(_cache(s, d).filter("cached_id % 20 = 0").withColumn("embedding", F.reverse("embedding")).withColumnRenamed("cached_id", "query_id"), _cache(s, d), F.lit("2024-01-01 01:30:00").cast("timestamp"), 0.25),
    f"""WITH c AS ({_CACHE}), q AS (SELECT * REPLACE (list_reverse(embedding) AS embedding) FROM c WHERE cached_id % 20 = 0), l AS (SELECT * FROM c WHERE cached_at > TIMESTAMP '2024-01-01 00:30:00'),
    m AS (SELECT q.cached_id AS query_id, l.cached_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])), 6) AS similarity FROM q JOIN l USING (organization, repository)),
    b AS (SELECT * FROM m WHERE similarity > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cached_id) = 1)
    SELECT q.cached_id AS query_id, coalesce(similarity >= 0.25e0, false) AS hit, CASE WHEN similarity >= 0.25e0 THEN b.cached_id END AS cached_id, similarity FROM q LEFT JOIN b ON b.query_id = q.cached_id""",
)
_SLIM = ("organization", "repository", "query", "response", "cached_at")
R.add(
    "r19_cache_put",
    lambda s, d: r.cache_put(_cache(s, d).filter("cached_id % 2 = 0").select(*_SLIM), _cache(s, d).filter("cached_id % 2 = 1").select(*_SLIM)).select("query_hash", "organization", "repository", "response"),
    f"WITH c AS ({_CACHE}) SELECT left(sha256(query), 16) AS query_hash, organization, repository, response FROM c QUALIFY row_number() OVER (PARTITION BY query, organization, repository ORDER BY cached_at DESC, cached_id % 2 DESC, response DESC) = 1",
)
R.add("r20_cache_clear", lambda s, d: r.cache_stats(r.cache_clear(_cache(s, d), 1, "3")), f"WITH c AS ({_CACHE}) SELECT organization, repository, count(*) AS entries FROM c WHERE NOT (organization = 1 AND repository = '3') GROUP BY 1, 2")
R.add(
    "r22_citations",
    lambda s, d: r.extract_citations(table(s, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("See [1] and ["), (F.col("o_orderkey") % 9).cast("string"), F.lit("], [1].")).alias("answer")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").cast("long").alias("number"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_path"))),
    "WITH a AS (SELECT DISTINCT o_orderkey AS answer_id, unnest([1, o_orderkey % 9]) AS number FROM orders) SELECT answer_id, number, 'f' || l_partkey AS file_path FROM a LEFT JOIN lineitem ON l_orderkey = answer_id AND l_linenumber = number",
)
