"""Hybrid retrieval for a table of queries: keyword and vector legs, fusion, boosts, contexts and the semantic cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessarine.functions.expr import bind, contains_any, content_preview, count_tokens, parse_query, query_hash
from tessarine.functions.predicates import noise_path
from tessarine.operators.cells import CellStore
from tessarine.operators.vectors import best_in_scope, pack_vectors
from tessarine.shared import materialize

#: Words that no posting holds, and the neutral weights but for noise.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
BOOSTS = {
    "chunk_type_boosts": {"docs": 1.0, "file_summary": 1.0, "class_summary": 1.0, "function": 1.0, "class": 1.0, "test": 1.0},
    "path_boost": 1.0, "breadcrumb_match_boost": 1.0, "quoted_match_boost": 1.0, "identifier_match_boost": 1.0, "noise_penalty": 0.3,
}
SCOPE = ("organization", "repository")
VECTOR_SCOPE = (*SCOPE, "model")
BROADCAST_ROWS = 200_000
RRF_K, LEG_LIMIT, CACHE_LEAST, CACHE_TTL = 60, 50, 0.95, 3600
NO_ANSWER = "I don't have enough information to answer that question. The query didn't match any code in the repository."
WORD = r"[\p{L}\p{N}_]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def counted_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast where it has at most ``most`` rows, by count; else joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def build_postings(chunks: DataFrame, key: str = "chunk_id", wanted: DataFrame | None = None) -> DataFrame:
    """(organization, repository, chunk_id, field, term, positions) of content and breadcrumb; positions count all words, stop words are dropped.

    With ``wanted`` (organization, repository, term; distinct), terms that nobody asks for there are dropped before anything is shuffled.
    Without, a chunk's words are grouped in its own row; only rows that share their chunk's key are shuffled and merged.
    """
    if wanted is None:
        return _whole_postings(chunks, key)
    fields = F.array(*(F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("words")) for f in ("content", "breadcrumb")))
    each = chunks.select(*SCOPE, key, F.explode(fields).alias("f")).select(*SCOPE, key, "f.field", F.posexplode("f.words").alias("at", "term"))
    kept = each.filter(~F.col("term").isin(*STOP_WORDS))
    kept = kept.join(counted_small(wanted), [*SCOPE, "term"], "left_semi")
    return kept.groupBy(*SCOPE, key, "field", "term").agg(F.sort_array(F.collect_list((F.col("at") + 1).cast("long"))).alias("positions"))


def _placed_terms(words: Column) -> Column:
    """array<struct<term,positions>> of an array of words without stop words: sorted by word and place, cut where the word changes."""
    every = F.transform(words, lambda w, i: F.struct(w.alias("term"), (i + 1).cast("long").alias("at")))
    own = F.sort_array(F.filter(every, lambda p: ~p["term"].isin(*STOP_WORDS)))

    def cut(rows: Column) -> Column:
        first = F.transform(rows, lambda p, i: F.when((i == 0) | (F.get(rows, i - 1)["term"] != p["term"]), i))
        until = lambda heads, k: F.coalesce(F.get(heads, k + 1), F.size(rows))
        group = lambda heads, h, k: F.struct(F.get(rows, h)["term"].alias("term"), F.slice(rows, h + 1, until(heads, k) - h)["at"].alias("positions"))
        return bind(F.filter(first, lambda h: h.isNotNull()), lambda heads: F.transform(heads, lambda h, k: group(heads, h, k)))

    return bind(own, cut)


def _whole_postings(chunks: DataFrame, key: str) -> DataFrame:
    own = [*SCOPE, key]
    fields = F.array(*(F.struct(F.lit(f).alias("field"), _placed_terms(terms(F.col(f))).alias("terms")) for f in ("content", "breadcrumb")))
    each = chunks.select(*own, F.explode(fields).alias("f")).select(*own, "f.field", F.explode("f.terms").alias("t")).select(*own, "field", "t.term", "t.positions")
    twice = chunks.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*(F.col(c).alias(f"_{c}") for c in own))
    if twice.isEmpty():
        return each
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own])
    twice = counted_small(twice)
    merged = each.join(twice, same, "left_semi").groupBy(*own, "field", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return each.join(twice, same, "left_anti").unionByName(merged)


def query_terms(queries: DataFrame) -> DataFrame:
    """(organization, repository, query_id, term, n_terms): distinct words of each query without stop words."""
    words = F.array_distinct(F.filter(terms(F.col("query")), lambda t: ~t.isin(*STOP_WORDS)))
    return queries.select(*SCOPE, "query_id", words.alias("words")).select(*SCOPE, "query_id", F.size("words").alias("n_terms"), F.explode("words").alias("term"))


def keyword_match(postings: DataFrame, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, field, hits) where a field of a chunk in the query's organization and repository holds all of its terms; hits are (position, term).

    A query without an organization or a repository matches nothing.
    """
    met = postings.join(counted_small(query_terms(queries)), [*SCOPE, "term"])
    g = met.groupBy("query_id", key, "field", "n_terms").agg(F.count(F.lit(1)).alias("found"), F.collect_list(F.struct("term", "positions")).alias("own"))
    hits = F.sort_array(F.flatten(F.transform("own", lambda o: F.transform(o["positions"], lambda p: F.struct(p.alias("at"), o["term"].alias("term"))))))
    return g.filter("found = n_terms").select("query_id", key, "field", "n_terms", hits.alias("hits"))


def cover_density(hits: Column, n_terms: Column) -> Column:
    """Sum over the minimal covers of 1 / their length in words.

    A cover ends at a hit and starts at the latest place from which all terms occur; it is minimal when it ends before
    the next cover with the same start.
    """

    def score(names: Column) -> Column:
        def latest(acc: Column, h: Column) -> Column:
            own = F.array_position(names, h["term"]) - 1
            seen = F.transform(acc["last"], lambda at, i: F.when(i == own, h["at"]).otherwise(at))
            return bind(seen, lambda last: bind(F.array_min(last), lambda start: after(acc, h, last, start)))

        none = F.struct(F.array_repeat(F.lit(0).cast("long"), n_terms).alias("last"), F.lit(0).cast("long").alias("from"), F.lit(0.0).alias("score"))
        return F.aggregate(hits, none, latest)["score"]

    def after(acc: Column, h: Column, last: Column, start: Column) -> Column:
        more = F.when(start > acc["from"], 1.0 / (h["at"] - start + 1)).otherwise(0.0)
        return F.struct(last.alias("last"), F.greatest(acc["from"], start).alias("from"), (acc["score"] + more).alias("score"))

    return bind(F.array_distinct(hits["term"]), score)


def keyword_leg(chunks: DataFrame | None, queries: DataFrame, limit: int = LEG_LIMIT, key: str = "chunk_id", postings: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best chunks of each query's repository, by the better of both fields, ties by id.

    ``postings`` may come from a PostingsStore; without one, the terms that are asked for in each repository are indexed.
    """
    if postings is None:
        postings = build_postings(chunks, key, query_terms(queries).select(*SCOPE, "term").distinct())
    matched = keyword_match(postings, queries, key)
    scored = matched.withColumn("s", cover_density(F.col("hits"), F.col("n_terms"))).groupBy("query_id", key).agg(F.round(F.max("s"), 6).alias("score"))
    return ranked(scored, limit, key)


def ranked(scored: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)


def vector_leg(chunks: DataFrame, queries: DataFrame, limit: int = LEG_LIMIT, key: str = "chunk_id", blocks: DataFrame | None = None, scope: tuple[str, ...] = VECTOR_SCOPE) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best rows of each query's organization, repository and model by cosine, ties by id; never the row of the query's own id.

    ``blocks`` may be a stored table of ``pack_vectors`` over the same scope; without one, ``chunks`` are packed.
    """
    return ranked(vector_heaps(chunks, queries, limit, key, blocks, scope), limit, key)


def vector_heaps(chunks: DataFrame, queries: DataFrame, limit: int, key: str = "chunk_id", blocks: DataFrame | None = None, scope: tuple[str, ...] = VECTOR_SCOPE, tol: float = 0.0) -> DataFrame:
    """(query_id, chunk_id, score) that holds each query's ``limit`` best rows, and all within ``tol`` of the last of them."""
    own = pack_vectors(chunks, list(scope), key) if blocks is None else blocks
    return best_in_scope(own, pack_vectors(queries, list(scope), "query_id", "asked"), list(scope), limit, key, tol)


def vector_leg_approx(chunks: DataFrame, queries: DataFrame, limit: int = LEG_LIMIT, slack: float = 0.25, key: str = "chunk_id", store: CellStore | None = None, scope: tuple[str, ...] = VECTOR_SCOPE) -> DataFrame:
    """The vector leg over inverted lists, ranked exactly: see ``CellStore``, which may be stored and passed."""
    own = CellStore(chunks, list(scope), key) if store is None else store
    return own.search(queries, limit, slack)[0]


def exact_with_tie_tail(scores: DataFrame, limit: int = LEG_LIMIT, tol: float = 1e-6, key: str = "chunk_id") -> DataFrame:
    """The best ``limit`` rows and every further one within ``tol`` of the last of them, in one pass over ``scores``: all, or those of ``vector_heaps`` with this ``tol``."""
    every = Window.partitionBy("query_id")
    placed = scores.withColumn("rank", F.row_number().over(every.orderBy(F.desc("score"), key)).cast("long"))
    last = F.max(F.when(F.col("rank") == limit, F.col("score"))).over(every)
    return placed.withColumn("_last", last).filter((F.col("rank") <= limit) | (F.col("_last") - F.col("score") <= tol)).drop("_last")


def rrf_fuse(legs: dict[str, DataFrame], k: int = RRF_K, key: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, rrf_score, sources, best_rank, fused_rank): sum of 1 / (k + rank) over the legs.

    Ties keep the order of legs, then rank, then id. Rows without an id are dropped.
    """
    every = reduce(DataFrame.unionByName, [leg.select("query_id", key, "rank", F.lit(name).alias("source"), F.lit(i).alias("leg")) for i, (name, leg) in enumerate(legs.items())])
    g = every.filter(F.col(key).isNotNull()).groupBy("query_id", key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min(F.struct("leg", "rank")).alias("first")
    )
    scored = g.withColumn("rrf_score", F.round("rrf", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first", key)
    return scored.select("query_id", key, "rrf_score", "sources", F.row_number().over(order).cast("long").alias("fused_rank"))


def merged(config: dict | None) -> dict:
    """The neutral weights with a partial configuration laid over them."""
    own = config or {}
    types = BOOSTS["chunk_type_boosts"] | own.get("chunk_type_boosts", {})
    return BOOSTS | own | {"chunk_type_boosts": types}


def boost_multiplier(config: dict | None = None, content_boosts: bool = True) -> Column:
    """Product of the weights that apply to chunk_type, file_path, breadcrumb, content, quoted_terms, identifiers."""
    c = merged(config)
    by_type = F.lit(1.0)
    for kind, weight in c["chunk_type_boosts"].items():
        by_type = F.when(F.col("chunk_type") == kind, weight).otherwise(by_type)
    noise = F.when(F.coalesce(noise_path(F.col("file_path")), F.lit(False)), c["noise_penalty"]).otherwise(1.0)
    crumb = F.when(contains_any(F.col("breadcrumb"), F.col("identifiers")), c["breadcrumb_match_boost"]).otherwise(1.0)
    out = by_type * noise * crumb
    if content_boosts:
        out = out * F.when(contains_any(F.col("content"), F.col("quoted_terms")), c["quoted_match_boost"]).otherwise(1.0)
        out = out * F.when(contains_any(F.col("content"), F.col("identifiers")), c["identifier_match_boost"]).otherwise(1.0)
    return out


def metadata_boost(fused: DataFrame, config: dict | None = None, content_boosts: bool = True) -> DataFrame:
    boosted = fused.withColumn("boost_multiplier", boost_multiplier(config, content_boosts))
    return boosted.withColumn("boosted_score", F.round(F.col("rrf_score") * F.col("boost_multiplier"), 12))


def top_k(boosted: DataFrame, k: int) -> DataFrame:
    """The best k of each query by boosted score; ties keep the fused order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("boosted_score"), "fused_rank")
    return boosted.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def enrich(results: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Results with their chunk's fields, a preview and the run's commit and date; a lost chunk drops its row, a lost run is ''."""
    c = chunks.select("chunk_id", "run_id", "file_path", "start_line", "end_line", "content", "breadcrumb", "language", "chunk_type")
    r = runs.select("run_id", "commit_sha", F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("ingestion_date"))
    j = results.join(c, "chunk_id").join(r, "run_id", "left")
    text = lambda n: F.coalesce(F.col(n), F.lit("")).alias(n)
    return j.select(*results.columns, "file_path", "start_line", "end_line", content_preview(F.col("content")).alias("preview"), text("breadcrumb"), text("language"), "chunk_type", "run_id", text("commit_sha"), text("ingestion_date"))


class Search:
    """Both legs of a table of queries, each written once, and what follows from them.

    ``queries``: query_id, organization, repository, query. ``chunks``: chunk_id, organization, repository, content,
    breadcrumb, file_path, start_line, end_line, language, chunk_type, run_id. ``vectors``: chunk_id, organization,
    repository, model, embedding; ``query_vectors`` the same with query_id. Stored ``postings`` and ``blocks`` spare the indexing.
    A query that neither leg answers has no row; one that a single leg answers keeps its rows.
    """

    def __init__(
        self, queries: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, config: dict | None = None, limit: int = LEG_LIMIT, content_boosts: bool = True,
        postings: DataFrame | None = None, blocks: DataFrame | None = None,
    ) -> None:
        self.queries, self.chunks = queries, chunks
        self.keyword = materialize(keyword_leg(chunks, queries, limit, postings=postings), "keyword")
        self.vector = materialize(vector_leg(vectors, query_vectors, limit, blocks=blocks), "vector")
        self.fused = rrf_fuse({"fts": self.keyword, "vector": self.vector})
        parsed = queries.select("query_id", parse_query(F.col("query")).alias("q")).select("query_id", "q.quoted_terms", "q.identifiers")
        self.boosted = metadata_boost(self.fused.join(chunks, "chunk_id").join(parsed, "query_id"), config, content_boosts)

    def results(self, runs: DataFrame, k: int = 10) -> DataFrame:
        """The k best chunks of each query, enriched. ``runs``: run_id, commit_sha, completed_at."""
        top = top_k(self.boosted, k).select("query_id", "rank", "chunk_id", "rrf_score", "boost_multiplier", "boosted_score", "sources")
        return enrich(top, self.chunks, runs)

    def trace(self, k: int = 5) -> DataFrame:
        """(query_id, stage, rank, chunk_id, score) of every stage."""
        as_score = lambda df, rank, score: df.select("query_id", F.col(rank).alias("rank"), "chunk_id", F.col(score).alias("score"))
        return search_trace({"fts": self.keyword, "vector": self.vector, "fused": as_score(self.fused, "fused_rank", "rrf_score"), "top": as_score(top_k(self.boosted, k), "rank", "boosted_score")})

    def stats(self) -> DataFrame:
        return search_stats(self.queries, self.keyword, self.vector, self.fused)


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, runs: DataFrame, k: int = 10, config: dict | None = None,
    limit: int = LEG_LIMIT, content_boosts: bool = True, postings: DataFrame | None = None, blocks: DataFrame | None = None,
) -> DataFrame:
    """The k best chunks of each query by keyword and vector legs within its organization and repository, fused, boosted and enriched; inputs as in ``Search``."""
    return Search(queries, chunks, vectors, query_vectors, config, limit, content_boosts, postings, blocks).results(runs, k)


def search_stats(queries: DataFrame, keyword: DataFrame, vector: DataFrame, fused: DataFrame) -> DataFrame:
    out = queries.select("query_id").distinct()
    for name, leg in (("fts_rows", keyword), ("vector_rows", vector), ("fused_rows", fused)):
        out = out.join(leg.groupBy("query_id").agg(F.count(F.lit(1)).alias(name)), "query_id", "left")
    return out.na.fill(0, ["fts_rows", "vector_rows", "fused_rows"])


def search_trace(stages: dict[str, DataFrame]) -> DataFrame:
    """(query_id, stage, rank, chunk_id, score) of every stage."""
    return reduce(DataFrame.unionByName, [df.select("query_id", F.lit(n).alias("stage"), "rank", "chunk_id", F.col("score").cast("double").alias("score")) for n, df in stages.items()])


def build_context(results: DataFrame) -> DataFrame:
    """(query_id, context, sources): numbered citations with fenced content, in rank order."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.when(F.length("breadcrumb") > 0, F.concat(F.lit(" ("), "breadcrumb", F.lit(")"))).otherwise(""))
    part = F.concat(head, F.lit("\n```\n"), "content", F.lit("\n```\n"))
    g = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("part"), "file_path"))).alias("rows"))
    return g.select("query_id", F.array_join("rows.part", "\n").alias("context"), F.array_join(F.transform("rows", lambda r: F.concat(r["rank"].cast("string"), F.lit(":"), r["file_path"])), ",").alias("sources"))


def fit_budget(results: DataFrame, max_tokens: int, overhead: int = 0) -> DataFrame:
    """The longest prefix of each query's ranked chunks whose tokens, with the prompt's ``overhead``, fit."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = results.withColumn("tokens", count_tokens(F.col("content"))).withColumn("running", F.sum("tokens").over(order) + overhead)
    return sized.filter(F.col("running") <= max_tokens)


def no_answer(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Every query with its answer, the fixed one at no cost where there is none."""
    j = queries.select("query_id").join(answers, "query_id", "left")
    return j.select("query_id", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"), F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"))


def cache_lookup(queries: DataFrame, cache: DataFrame, now: Column, least: float = CACHE_LEAST, ttl: int = CACHE_TTL) -> DataFrame:
    """(query_id, hit, cached_id, similarity): the nearest unexpired entry of the same organization and repository, ties to the smaller id."""
    live = cache.filter(F.col("cached_at") > now - F.make_dt_interval(secs=F.lit(ttl)))
    blocks, asked = pack_vectors(live, list(SCOPE), "cached_id"), pack_vectors(queries, list(SCOPE), "query_id", "asked")
    near = ranked(best_in_scope(blocks, asked, list(SCOPE), 1, "cached_id", apart=False, least=1 / 1e6), 1, "cached_id")
    found = near.select("query_id", "cached_id", F.col("score").alias("similarity"))
    j = queries.select("query_id").join(found, "query_id", "left")
    hit = F.coalesce(F.col("similarity") >= least, F.lit(False))
    return j.select("query_id", hit.alias("hit"), F.when(hit, F.col("cached_id")).alias("cached_id"), "similarity")


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries by (query hash, organization, repository); the latest cached_at wins, new entries on a tie."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1))).withColumn("query_hash", query_hash(F.col("query")))
    order = Window.partitionBy("query_hash", "organization", "repository").orderBy(F.desc("cached_at"), F.desc("_new"), F.desc("response"))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def cache_clear(cache: DataFrame, organization: int | str | None = None, repository: str | None = None, everything: bool = False) -> DataFrame:
    """What stays after clearing a scope. All goes only when asked by name; a repository needs its organization."""
    if everything:
        if organization is not None or repository is not None:
            raise ValueError("clear everything, or a scope")
        return cache.limit(0)
    if organization is None:
        raise ValueError("name an organization, or say everything=True")
    gone = F.col("organization") == organization
    if repository is not None:
        gone = gone & (F.col("repository") == repository)
    return cache.filter(~F.coalesce(gone, F.lit(False)))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("organization", "repository").agg(F.count(F.lit(1)).alias("entries"))


def extract_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, number, file_path) of every distinct [n] in an answer; numbers without a source keep a null path."""
    found = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,9})\]"), F.lit(1)))
    each = answers.select("answer_id", F.explode(F.transform(found, lambda n: n.cast("long"))).alias("number"))
    return each.join(sources.select("answer_id", "number", "file_path"), ["answer_id", "number"], "left")


def filter_results(results: DataFrame, chunk_type: str | None = None, repository: str | None = None) -> DataFrame:
    """Search results of one chunk type and repository; None keeps all."""
    out = results if chunk_type is None else results.filter(F.col("chunk_type") == chunk_type)
    return out if repository is None else out.filter(F.col("repository") == repository)
