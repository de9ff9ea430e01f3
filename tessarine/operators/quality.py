"""Data-quality checks: each returns a table of violations (check, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, check: str, bad: Column, key: Column, detail: Column) -> DataFrame:
    return df.filter(F.coalesce(bad, F.lit(False))).select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def check_domains(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows for which a rule's condition is false; a null condition passes, as in SQL."""
    return all_of(*(violations(df, name, ~fine, F.col(key), F.lit(name)) for name, fine in rules.items()))


def check_foreign_keys(child: DataFrame, parent: DataFrame, keys: dict[str, str], check: str, key: str) -> DataFrame:
    """Children whose whole key has no parent; keys with a null are not checked."""
    p = parent.select(*(F.col(v).alias(k) for k, v in keys.items())).distinct()
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    orphans = child.filter(whole).join(p, list(keys), "left_anti")
    return violations(orphans, check, F.lit(True), F.col(key), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)))


def check_unique(df: DataFrame, keys: list[str], check: str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return violations(g, check, F.lit(True), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)), F.col("n"))


def repository_tenant_drift(repositories: DataFrame, projects: DataFrame) -> DataFrame:
    p = projects.select("project_id", F.col("organization_id").alias("of"))
    j = repositories.join(p, "project_id")
    return violations(j, "repository_tenant", ~F.col("organization_id").eqNullSafe(F.col("of")), F.col("repository_id"), F.col("of"))


def chunk_tenant_drift(chunks: DataFrame, symbols: DataFrame, repositories: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunks and symbols of another organization than their repository's; chunks of a run or symbol of another repository."""
    r = repositories.select("repository_id", F.col("organization_id").alias("of"))
    other = lambda df, check, key: violations(df.join(r, "repository_id", "left"), check, ~F.col("organization_id").eqNullSafe(F.col("of")), F.col(key), F.col("of"))
    by_run = chunks.join(runs.select("run_id", F.col("repository_id").alias("rr")), "run_id", "left")
    by_symbol = chunks.filter("symbol_id is not null").join(symbols.select("symbol_id", F.col("repository_id").alias("rr")), "symbol_id", "left")
    strays = lambda df, check: violations(df, check, ~F.col("repository_id").eqNullSafe(F.col("rr")), F.col("chunk_id"), F.col("rr"))
    return all_of(other(chunks, "chunk_organization", "chunk_id"), other(symbols, "symbol_organization", "symbol_id"), strays(by_run, "chunk_run"), strays(by_symbol, "chunk_symbol"))


def breadcrumb_mismatch(chunks: DataFrame) -> DataFrame:
    bad = ~F.nullif(F.col("breadcrumb"), F.lit("")).eqNullSafe(F.nullif(F.col("meta_breadcrumb"), F.lit("")))
    return violations(chunks, "breadcrumb", bad, F.col("chunk_id"), F.col("meta_breadcrumb"))


def check_targets(questions: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions whose file is not in the corpus (fail), whose symbol no chunk is named by, or that name it (warn)."""
    lost = questions.join(files.select("path").distinct(), "path", "left_anti")
    named = chunks.select(F.col("breadcrumb").alias("b"), F.element_at(F.split("breadcrumb", r"\."), -1).alias("symbol")).select("symbol").distinct()
    unnamed = questions.filter("symbol is not null").join(named, "symbol", "left_anti")
    told = questions.filter(F.contains(F.lower("question"), F.lower("symbol")))
    return all_of(violations(lost, "file_missing", F.lit(True), F.col("id"), F.col("path")), violations(unnamed, "symbol_missing", F.lit(True), F.col("id"), F.col("symbol")), violations(told, "symbol_told", F.lit(True), F.col("id"), F.col("symbol")))


def check_question_specs(questions: DataFrame, sets: tuple[str, ...]) -> DataFrame:
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rows = check_domains(
        questions, "id",
        {"set": F.col("set").isin(*sets), "question": ~blank("question"), "path": ~blank("path"), "symbol": F.col("symbol").isNull() | (F.trim("symbol") != ""), "commit": F.col("commit").rlike("^[0-9a-f]{40}$")},
    )
    return rows.unionByName(check_unique(questions, ["id"], "unique_id"))


LEVELS, SCOPES = ("file", "symbol"), ("pooled", "each")


def check_rule_schema(clauses: DataFrame) -> DataFrame:
    """Clause rows (id, level, scope, min_delta, allowance) of a decision rule."""
    finite = F.col("min_delta").isNotNull() & ~F.isnan("min_delta") & (F.abs("min_delta") < float("inf"))
    rules = {"level": F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), "scope": F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)), "min_delta": finite, "allowance": F.coalesce((F.col("allowance") >= 0) & (F.col("allowance") < 1e-6), F.lit(False))}
    return check_domains(clauses, "id", rules).unionByName(check_unique(clauses, ["id"], "unique_id"))


def check_comparable_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Question rows (id, question, set, vector_hash, error) of two runs that may not be compared."""
    b = before.select("id", *(F.col(c).alias(f"b_{c}") for c in ("question", "set", "vector_hash", "error")))
    a = after.select("id", *(F.col(c).alias(f"a_{c}") for c in ("question", "set", "vector_hash", "error")))
    j = b.withColumn("in_b", F.lit(True)).join(a.withColumn("in_a", F.lit(True)), "id", "full")
    both = F.col("in_a") & F.col("in_b")
    differs = lambda c: both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    checks = [("missing", F.col("in_a").isNull() | F.col("in_b").isNull()), ("question", differs("question")), ("set", differs("set")), ("vector", differs("vector_hash") | (both & F.col("a_vector_hash").isNull())), ("failed", F.col("a_error").isNotNull() | F.col("b_error").isNotNull())]
    repeats = [check_unique(df, ["id"], name) for df, name in ((before, "repeated_before"), (after, "repeated_after"))]
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks)))
    each = j.select(F.col("id").cast("string").alias("key"), F.explode(found).alias("check"))  # one join for all checks
    return all_of(each.select("check", "key", F.col("check").alias("detail")), *repeats)


def check_comparable_headers(before: DataFrame, after: DataFrame, settings: list[str], on: list[str]) -> DataFrame:
    """(check, key, detail): headers of two runs, one for each value of ``on``, that differ in a setting, or that only one run has.

    Null equals null. The detail holds both values.
    """
    b = before.select(*on, F.lit(True).alias("in_b"), *(F.col(c).cast("string").alias(f"b_{c}") for c in settings))
    a = after.select(*on, F.lit(True).alias("in_a"), *(F.col(c).cast("string").alias(f"a_{c}") for c in settings))
    j = b.join(a, on, "full")
    key = F.concat_ws("/", *on)
    value = lambda side, c: F.coalesce(F.col(f"{side}_{c}"), F.lit("null"))
    both = F.col("in_a") & F.col("in_b")
    differs = [violations(j, f"setting_{c}", both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), key, F.concat(value("b", c), F.lit(" -> "), value("a", c))) for c in settings]
    return all_of(violations(j, "missing_header", F.col("in_a").isNull() | F.col("in_b").isNull(), key, F.lit("missing_header")), *differs)


def check_recorded_ranks(questions: DataFrame, top: DataFrame) -> DataFrame:
    """(check, key, detail): questions (id, path, file_rank) whose recorded rank isn't that of their path's first row in ``top`` (id, rank, file_path)."""
    again = questions.select("id", "path").join(top.select("id", "rank", F.col("file_path").alias("path")), ["id", "path"]).groupBy("id").agg(F.min("rank").alias("again"))
    j = questions.select("id", "file_rank").join(again, "id", "left")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return violations(j, "rank", ~F.col("file_rank").eqNullSafe(F.col("again")), F.col("id"), F.concat(said("file_rank"), F.lit(" for "), said("again")))
