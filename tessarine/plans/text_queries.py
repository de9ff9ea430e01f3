"""Registered queries of the path and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.functions import expr as x
from tessarine.functions import predicates as p
from tessarine.operators.chunking import skip_counts
from tessarine.plans.roles import FILES, Registry, files, table

R = Registry()
_LANG = "CASE regexp_extract(lower({0}), '[^.].*?(\\.[^.]*)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in p.LANGUAGES.items()) + " END"
_LANGUAGE = _LANG.format("name")
_EXT = "regexp_replace(regexp_extract(lower(name), '[^.].*?(\\.[^.]*)$', 1), '^\\.', '')"
_DIRS = repr(list(p.VENDORED_DIRS))
_TOKENS = "len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"


def on_files(columns):
    """Columns over the files; made when the query runs, as they need a session."""
    return lambda s, d: files(s, d).select("doc_id", *columns())


CLASSIFIED = f"""WITH files AS ({FILES}), j AS (SELECT *, CASE WHEN regexp_matches(lower(name), '{p.SECRET_REGEX}') OR (split(path, '/')[-2] = '.aws' AND name = 'credentials') THEN 'secret'
    WHEN len(list_intersect(list_transform(split(path, '/')[:-2], lambda q: lower(q)), {_DIRS})) > 0 THEN 'vendored' WHEN regexp_matches(lower(name), '{p.GENERATED_REGEX}') THEN 'generated'
    WHEN name IN {p.LOCK_FILES} THEN 'lockfile' WHEN {_LANGUAGE} IS NULL THEN 'unsupported' ELSE 'indexable' END AS reason FROM files)
    SELECT doc_id, path, repository, reason, CASE WHEN reason = 'indexable' THEN {_LANGUAGE} END AS language FROM j"""
R.add(
    "p1_classify_path",
    lambda s, d: files(s, d).select("doc_id", "path", p.classify_path(F.col("path")).alias("c")).select("doc_id", "path", "c.reason", "c.language"),
    f"SELECT doc_id, path, reason, language FROM ({CLASSIFIED})",
)
R.add(
    "p12_skip_counts",
    lambda s, d: skip_counts(files(s, d).select("repository", p.classify_path(F.col("path"))["reason"].alias("reason"))),
    f"SELECT repository, reason, count(*) AS files FROM ({CLASSIFIED}) WHERE reason <> 'indexable' GROUP BY 1, 2",
)
R.add("p2_secret_names", on_files(lambda: ("name", p.is_secret_name(F.col("name")).alias("secret"),)), f"WITH files AS ({FILES}) SELECT doc_id, name, regexp_matches(lower(name), '{p.SECRET_REGEX}') AS secret FROM files")
_HEAD = "// Code generated by tool. DO NOT EDIT.\n"
R.add(
    "p3_generated_source",
    on_files(lambda: (p.is_generated_source(F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("\n" + _HEAD))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit(_HEAD), "content")).otherwise(F.col("content"))).alias("generated"),)),
    f"""WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || chr(10) || '{_HEAD.strip()}' || chr(10) WHEN 1 THEN '{_HEAD.strip()}' || chr(10) || text ELSE text END AS t FROM documents)
    SELECT doc_id, len(list_filter(split(t, chr(10))[1:20], lambda l: regexp_matches(l, '^// Code generated .* DO NOT EDIT\\.\\r*$'))) > 0 AS generated FROM f""",
)
_ODD = ("a/b.py", "/abs.py", "C:x", "a//b", "../up", "a\\b", "tab\there", "", "ok/./x", "é/ü.py")
R.add(
    "p4_unsafe_path",
    lambda s, d: table(s, d, "documents").select("doc_id", p.unsafe_path(F.concat(F.element_at(F.array(*map(F.lit, _ODD)), (F.col("doc_id") % 10 + 1).cast("int")), F.when(F.col("doc_id") % 3 == 0, "/z").otherwise(""))).alias("unsafe")),
    """WITH f AS (SELECT doc_id, (['a/b.py', '/abs.py', 'C:x', 'a//b', '../up', 'a\\b', 'tab' || chr(9) || 'here', '', 'ok/./x', 'é/ü.py'])[doc_id % 10 + 1] || CASE WHEN doc_id % 3 = 0 THEN '/z' ELSE '' END AS path FROM documents)
    SELECT doc_id, path = '' OR contains(path, '\\') OR contains(path, chr(9)) OR regexp_matches(path, '^([A-Za-z]:|/)') OR len(list_filter(split(path, '/'), lambda q: q IN ('', '.', '..'))) > 0 AS unsafe FROM f""",
)
R.add("p5_noise_path", on_files(lambda: ("path", p.noise_path(F.col("path")).alias("noise"),)), f"WITH files AS ({FILES}) SELECT doc_id, path, regexp_matches(replace(path, '\\', '/'), '{p.NOISE_PATH}') AS noise FROM files")
R.add(
    "p6_valid_query",
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", p.valid_query(F.col("text"), F.col("turn") * 9).alias("valid")),
    "SELECT conv_id, turn, coalesce(length(text) BETWEEN 1 AND 1000 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AND turn * 9 BETWEEN 1 AND 50, false) AS valid FROM conversations",
)
_MAIL = ("mailinator.com", "corp.example.org", "x.temp-mail.org", "a.b.guerrillamail.com", "mail.example.net")
_BAD = ("mailinator.com", "temp-mail.org", "guerrillamail.com")
R.add(
    "p7_disposable_email",
    lambda s, d: table(s, d, "customer").select("c_custkey", p.disposable_email(F.concat(F.lit("U"), F.col("c_custkey").cast("string"), F.lit("@"), F.upper(F.element_at(F.array(*map(F.lit, _MAIL)), (F.col("c_custkey") % 5 + 1).cast("int")))), _BAD).alias("disposable")),
    f"WITH c AS (SELECT c_custkey, ({list(_MAIL)!r})[c_custkey % 5 + 1] AS domain FROM customer) SELECT c_custkey, domain IN {_BAD} OR regexp_matches(domain, '\\.(mailinator\\.com|temp-mail\\.org|guerrillamail\\.com)$') AS disposable FROM c",
)


def _purpose_sql(table_, otherwise: str, name: str = "name") -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({name}), '{w}')" for w in words) + f" THEN '{said}'" for words, said in table_) + f" ELSE {otherwise} END"


_FILE_SQL = f"""CASE WHEN contains(name, '_test') OR contains(name, '.test.') OR starts_with(name, 'test_') THEN 'Test file' WHEN name = '__init__.py' THEN 'Package initialization'
    WHEN name IN ('main.go', 'main.py') THEN 'Application entry point' ELSE {_purpose_sql(p.FILE_PURPOSES, "CASE WHEN doc_id % 2 > doc_id % 3 THEN 'Class definitions' WHEN doc_id % 3 > 0 THEN 'Function implementations' ELSE 'Source file' END")} END"""
R.add("p8_file_purpose", on_files(lambda: ("name", p.infer_file_purpose(F.col("name"), F.col("doc_id") % 3, F.col("doc_id") % 2).alias("purpose"),)), f"WITH files AS ({FILES}) SELECT doc_id, name, {_FILE_SQL} AS purpose FROM files")
R.add(
    "p9_class_purpose",
    lambda s, d: table(s, d, "part").select("p_partkey", p.infer_class_purpose(F.concat(F.element_at(F.array(*map(F.lit, ("User", "Repo", "Job", "Form"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("Service", "Manager", "Builder", "Validator", "Thing"))), (F.col("p_partkey") % 5 + 1).cast("int")))).alias("purpose")),
    f"WITH c AS (SELECT p_partkey, (['User', 'Repo', 'Job', 'Form'])[p_partkey % 4 + 1] || (['Service', 'Manager', 'Builder', 'Validator', 'Thing'])[p_partkey % 5 + 1] AS name FROM part) SELECT p_partkey, {_purpose_sql(p.CLASS_PURPOSES, 'name || ' + repr(' implementation'))} AS purpose FROM c",
)
R.add(
    "p10_ext_language",
    on_files(lambda: ("name", p.ext_language(F.col("name")).alias("language"), p.code_or_docs(F.col("name")).alias("kind"),)),
    f"WITH files AS ({FILES}) SELECT doc_id, name, coalesce({_LANGUAGE}, {_EXT}) AS language, CASE WHEN {_EXT} IN {p.DOC_EXTENSIONS} THEN 'docs' ELSE 'code' END AS kind FROM files",
)
R.add(
    "x1_parse_query",
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", x.parse_query(F.concat(F.lit('find "'), F.substring("text", 1, 12), F.lit("\" getUserById in AuthService 'x y' snake_case_name "), F.regexp_replace("text", r"[^\x20-\x7e]", ""))).alias("q")).select(
        "conv_id", "turn", F.array_join("q.quoted_terms", "|").alias("quoted_terms"), F.array_join("q.identifiers", "|").alias("identifiers"), "q.clean_query"),
    r"""WITH t AS (SELECT conv_id, turn, 'find "' || substr(text, 1, 12) || '" getUserById in AuthService ''x y'' snake_case_name ' || regexp_replace(text, '[^\x20-\x7e]', '', 'g') AS q FROM conversations),
    n AS (SELECT *, regexp_extract_all(q, '\b[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b') || regexp_extract_all(q, '\b[a-z]+[A-Z][a-zA-Z0-9]*\b') || regexp_extract_all(q, '\b[a-z_][a-z0-9_]{2,}\b') AS names FROM t)
    SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(q, '"[^"]+"|''[^'']+'''), lambda m: substr(m, 2, length(m) - 2)), '|') AS quoted_terms,
    array_to_string(list_filter(names, lambda v, i: list_position(names, v) = i), '|') AS identifiers, trim(regexp_replace(q, '"[^"]+"|''[^'']+''', '', 'g')) AS clean_query FROM n""",
)
R.add(
    "x2_contains_any",
    lambda s, d: table(s, d, "documents").select("doc_id", x.contains_any(F.col("text"), F.array(F.lit("THENTI"), F.lit("stand"), F.col("lang"))).alias("found")),
    "SELECT doc_id, contains(lower(text), 'thenti') OR contains(lower(text), 'stand') OR contains(lower(text), lang) AS found FROM documents",
)
R.add(
    "x3_breadcrumb",
    on_files(lambda: (x.breadcrumb(F.split("path", "/"), F.col("lang")).alias("breadcrumb"),)),
    f"WITH files AS ({FILES}) SELECT doc_id, array_to_string((list_filter(split(path, '/'), lambda q: q <> '') || [lang])[-4:], '.') AS breadcrumb FROM files",
)
R.add(
    "x4_embedding_text",
    lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(x.embedding_text(F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.when(F.col("doc_id") % 2 > 0, F.col("lang")), F.col("text")), 256).alias("hash")),
    """SELECT doc_id, sha256(CASE WHEN doc_id % 3 > 0 THEN '# ' || source || chr(10) || chr(10) ELSE '' END || CASE WHEN doc_id % 2 > 0 THEN '\"\"\"' || lang || '\"\"\"' || chr(10) || chr(10) ELSE '' END || text) AS hash FROM documents""",
)
R.add(
    "x5_split_lines",
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(x.split_lines(F.col("text"))).cast("long").alias("n_lines"), F.size(x.split_lines(F.concat("text", F.lit("\n")))).cast("long").alias("n_closed")),
    """WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS a, text FROM documents)
    SELECT doc_id, CAST(len(a) - CASE WHEN a[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n_lines, CAST(CASE WHEN text = '' THEN 1 ELSE len(a) END AS BIGINT) AS n_closed FROM l""",
)
R.add("x6_content_preview", lambda s, d: table(s, d, "documents").select("doc_id", x.content_preview(F.col("text")).alias("preview")), "SELECT doc_id, left(text, 200) AS preview FROM documents")
R.add(
    "x7_content_hash",
    lambda s, d: table(s, d, "documents").select("doc_id", x.content_hash(F.col("text")).alias("content_hash"), x.query_hash(F.col("text")).alias("query_hash")),
    "SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 16) AS query_hash FROM documents",
)
R.add(
    "x7_vector_hash",
    lambda s, d: table(s, d, "embeddings").select("vec_id", x.vector_hash(F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000) / 1000)).alias("hash")),
    "SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda v: printf('%.9f', floor(CAST(v AS DOUBLE) * 1000) / 1000)), ',')) AS hash FROM embeddings",
)
_LEAK = "token ghp_abc123DEF sk-live_9-x github_pat_11A_b eyJhbGci.eyJzdWIi.sig-1 "
R.add(
    "x8_redact",
    lambda s, d: table(s, d, "documents").select("doc_id", x.redact(F.concat(F.lit(_LEAK), "text")).alias("safe")),
    f"""WITH r AS (SELECT doc_id, regexp_replace('{_LEAK}' || text, '{x.CREDENTIAL}', '[REDACTED]', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 2000 THEN left(t, 1985) || '... [truncated]' ELSE t END AS safe FROM r""",
)
R.add(
    "x9_redact_json",
    lambda s, d: table(s, d, "events").select("event_id", F.to_json(x.redact_json(F.create_map(F.lit("k"), F.concat(F.lit("ghp_x"), F.col("event_id").cast("string")), F.lit("e"), F.col("event_type")))).alias("safe")),
    """SELECT event_id, '{"k":"[REDACTED]","e":"' || event_type || '"}' AS safe FROM events""",
)


def _nested(s, d):
    """Events as values of structs, arrays and maps with a secret at each depth."""
    secret = F.concat(F.lit("ghp_x"), F.col("event_id").cast("string"))
    value = F.struct(secret.alias("a"), F.array(F.struct(F.col("event_type").alias("b"), F.create_map(secret, F.array(secret, F.col("event_type"))).alias("m"))).alias("list"), F.col("event_id").alias("n"))
    e = table(s, d, "events").select("event_id", value.alias("v"))
    return e.select("event_id", F.to_json(x.redact_nested(F.col("v"), e.schema["v"].dataType)).alias("safe"), x.redact_json_text(F.to_json("v")).alias("safe_text"))


_SAFE_JSON = """'{"a":"[REDACTED]","list":[{"b":"' || event_type || '","m":{"[REDACTED]":["[REDACTED]","' || event_type || '"]}}],"n":' || event_id || '}'"""
R.add("x9_redact_nested", _nested, f"SELECT event_id, {_SAFE_JSON} AS safe, {_SAFE_JSON} AS safe_text FROM events")
R.add("x10_count_tokens", lambda s, d: table(s, d, "documents").select("doc_id", x.count_tokens(F.col("text")).alias("tokens")), f"SELECT doc_id, CAST({_TOKENS.format('text')} AS BIGINT) AS tokens FROM documents")
R.add(
    "x11_llm_cost",
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_partkey").alias("a"), F.sum("l_suppkey").alias("b")).select("l_returnflag", F.round(x.llm_cost(F.col("a"), F.col("b")), 6).alias("cost"), F.round(x.embed_cost(F.col("a"), "small"), 6).alias("embed")),
    "SELECT l_returnflag, round((sum(l_partkey) * 0.15e0 + sum(l_suppkey) * 0.60e0) / 1e6, 6) AS cost, round(sum(l_partkey) * 0.02e0 / 1e6, 6) AS embed FROM lineitem GROUP BY 1",
)
R.add(
    "x12_backoff_bounds",
    lambda s, d: table(s, d, "orders").select("o_orderkey", x.backoff_seconds(F.col("o_orderkey") % 30).alias("longest"), (x.backoff_seconds(F.col("o_orderkey") % 30) / 2).alias("least"), (x.jittered_backoff(F.col("o_orderkey") % 30, F.col("o_orderkey")) < x.backoff_seconds(F.col("o_orderkey") % 30)).alias("inside")),
    "WITH b AS (SELECT o_orderkey, least(60e0 * pow(4e0, least(greatest(o_orderkey % 30 - 1, 0), 16)), 3600e0) AS s FROM orders) SELECT o_orderkey, s AS longest, s / 2 AS least, true AS inside FROM b",
)
R.add(
    "x13_cosine_similarity",
    lambda s, d: table(s, d, "embeddings").alias("a").join(table(s, d, "embeddings").alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select(F.col("a.vec_id").alias("vec_id"), F.round(x.cosine_similarity(F.col("a.embedding"), F.col("b.embedding")), 6).alias("similarity")),
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
R.add("x14_module_docstring", lambda s, d: table(s, d, "documents").select("doc_id", x.module_docstring(F.concat(F.lit('# head\n"""About\nit"""\n'), "text")).alias("docstring")), "SELECT doc_id, 'About it' AS docstring FROM documents")
R.add(
    "x15_matches",
    on_files(lambda: (x.path_matches(F.col("path"), F.concat("repository", F.lit("/src"))).alias("in_path"), x.symbol_matches(F.concat_ws(".", "repository", "lang"), F.col("lang")).alias("of_symbol"),)),
    f"WITH files AS ({FILES}) SELECT doc_id, contains(path, repository || '/src') AS in_path, ends_with(repository || '.' || lang, '.' || lang) AS of_symbol FROM files",
)
