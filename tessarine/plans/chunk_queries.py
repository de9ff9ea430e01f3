"""Registered queries of chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarine.operators import chunking as c
from tessarine.plans.roles import FILES, Registry, files, table

R = Registry()
SIZE, OVERLAP = 12, 2
def _spans_sql(size: int, overlap: int) -> str:
    end = f"CASE WHEN s + {size} >= n THEN n ELSE coalesce(list_min(list_transform(list_filter(range(greatest(s + 1, s + {size} - 5), least(n, s + {size} + 5)), lambda i: trim(a[i + 1]) = ''), lambda i: {{'far': abs(i - (s + {size})), 'i': i}})).i + 1, s + {size}) END"
    return f"""RECURSIVE files AS ({FILES}),
raw AS (SELECT doc_id, path, regexp_split_to_array(content, '\\r\\n|[\\n\\r]') AS b FROM files),
lines AS (SELECT doc_id, path, CASE WHEN b[-1] = '' THEN b[:-2] ELSE b END AS a FROM raw),
walk AS (SELECT doc_id, path, a, len(a) AS n, CAST(0 AS BIGINT) AS s, CAST({end.replace(' n ', ' len(a) ').replace('>= n', '>= len(a)').replace('least(n,', 'least(len(a),').replace('(s + ', '(0 + ').replace('s + ', '0 + ')} AS BIGINT) AS e FROM lines
  UNION ALL SELECT doc_id, path, a, n, greatest(e - {overlap}, s + 1) AS s, CAST({end.replace('s + ', 'greatest(e - ' + str(overlap) + ', s + 1) + ')} AS BIGINT) AS e FROM walk WHERE e < n),
chunks AS (SELECT doc_id, path, CASE WHEN n = 0 THEN 1 ELSE s + 1 END AS start_line, CASE WHEN n = 0 THEN 1 ELSE e END AS end_line, array_to_string(a[s + 1:e], chr(10)) AS content FROM walk)"""


def fixed(s, d, size=SIZE, overlap=OVERLAP):
    return c.chunk_fixed(files(s, d), size, overlap)


for _name, _size, _overlap in (("c1_chunk_fixed", 50, 5), ("c1_chunk_fixed_small", SIZE, OVERLAP)):
    R.add(
        _name,
        lambda s, d, a=_size, b=_overlap: fixed(s, d, a, b).select("doc_id", "path", "start_line", "end_line", F.sha2("content", 256).alias("hash")),
        f"WITH {_spans_sql(_size, _overlap)} SELECT doc_id, path, start_line, end_line, sha256(content) AS hash FROM chunks",
    )

SPANS = "SELECT path, doc_id, 1 + doc_id % 3 AS start_line, 3 + doc_id % 5 AS end_line FROM files"
R.add(
    "c2_chunk_spans",
    lambda s, d: c.chunk_spans(files(s, d), files(s, d).select("path", "doc_id", (1 + F.col("doc_id") % 3).alias("start_line"), (3 + F.col("doc_id") % 5).alias("end_line"))).select("doc_id", "start_line", "end_line", F.sha2("content", 256).alias("hash")),
    f"""WITH files AS ({FILES}), l AS (SELECT path, regexp_split_to_array(content, '\\r\\n|[\\n\\r]') AS b FROM files), s AS ({SPANS})
    SELECT doc_id, start_line, end_line, sha256(array_to_string((CASE WHEN b[-1] = '' THEN b[:-2] ELSE b END)[start_line:end_line], chr(10))) AS hash FROM s JOIN l USING (path)""",
)
def _code():
    """Python text around each document, as comments."""
    return F.concat(F.lit("@wrap\ndef alpha_"), F.col("doc_id").cast("string"), F.lit("(x):\n    return x\n\nclass Beta:\n    def gamma(self):\n        pass\n"), F.lit("# "), F.regexp_replace("content", "\n", "\n# "), F.lit("\ndef omega():\n    pass\n"))


R.add(
    "c3_definitions",
    lambda s, d: c.extract_definitions(files(s, d).select("path", F.lit("python").alias("language"), _code().alias("content"))),
    f"""WITH files AS ({FILES}), n AS (SELECT path, doc_id, CAST(8 + len(string_split(content, chr(10))) AS BIGINT) AS last FROM files)
    SELECT path, 'python' AS language, k.kind AS kind, replace(k.name, '#', CAST(doc_id AS VARCHAR)) AS name, CASE k.a WHEN -1 THEN last ELSE k.a END AS start_line, CASE k.b WHEN -1 THEN last + 1 WHEN -2 THEN last - 1 ELSE k.b END AS end_line
    FROM n, (SELECT unnest([{{'kind': 'function', 'name': 'alpha_#', 'a': 1, 'b': 4}}, {{'kind': 'class', 'name': 'Beta', 'a': 5, 'b': -2}}, {{'kind': 'function', 'name': 'gamma', 'a': 6, 'b': -2}}, {{'kind': 'function', 'name': 'omega', 'a': -1, 'b': -1}}]) AS k)""",
)
R.add(
    "c4_doc_comments",
    lambda s, d: c.doc_comment_above(
        files(s, d).select("path", F.lit("go").alias("language"), F.concat(F.lit("// loose\n\n// Says "), "name", F.lit("\n//go:noinline\n// and more\nfunc x() {}\n"), "content").alias("content")),
        files(s, d).select("path", F.lit(6).cast("long").alias("start_line")),
    ),
    f"WITH files AS ({FILES}) SELECT path, CAST(6 AS BIGINT) AS start_line, 'Says ' || name || chr(10) || 'and more' AS comment FROM files",
)
_DEFS = "SELECT CAST(l_orderkey AS VARCHAR) AS path, 'd' || l_linenumber AS name, CAST(l_linenumber * 3 - (l_partkey % 7) AS BIGINT) AS start_line, CAST(l_linenumber * 3 + (l_suppkey % 9) AS BIGINT) AS end_line FROM lineitem"


def definitions(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_linenumber") * 3 - F.col("l_partkey") % 7).cast("long").alias("start_line"), (F.col("l_linenumber") * 3 + F.col("l_suppkey") % 9).cast("long").alias("end_line"))


R.add(
    "c5_ancestors",
    lambda s, d: c.ancestors(definitions(s, d).distinct()).select("path", "name", "start_line", F.array_join("ancestor_chain", ".").alias("chain")),
    f"""WITH d AS (SELECT DISTINCT * FROM ({_DEFS})) SELECT a.path, a.name, a.start_line, coalesce(string_agg(b.name, '.' ORDER BY b.start_line, -b.end_line, b.name), '') AS chain
    FROM d a LEFT JOIN d b ON a.path = b.path AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND (b.start_line < a.start_line OR b.end_line > a.end_line) GROUP BY a.path, a.name, a.start_line, a.end_line""",
)
_KEPT = lambda s, d: files(s, d).filter("doc_id % 3 = 0").select("path", F.lit(1).cast("long").alias("start_line"), F.lit(2).cast("long").alias("end_line"), F.lit("x").alias("content"), F.lit("function").alias("chunk_type"))
R.add(
    "c6_fallback_chunks",
    lambda s, d: c.fallback_chunks(files(s, d), _KEPT(s, d), SIZE, OVERLAP).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("chunks"), F.sum("end_line").alias("ends")),
    f"""WITH {_spans_sql(SIZE, OVERLAP)}, every AS (SELECT 'function' AS chunk_type, 2 AS end_line FROM files WHERE doc_id % 3 = 0 UNION ALL SELECT 'fixed_size', end_line FROM chunks WHERE doc_id % 3 <> 0)
    SELECT chunk_type, count(*) AS chunks, CAST(sum(end_line) AS BIGINT) AS ends FROM every GROUP BY chunk_type""",
)
_ORDER_FILES = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.element_at(F.array(*map(F.lit, ("test_a.py", "x_model.py", "thing.py"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("name"), (F.col("o_orderkey") % 40).alias("lines"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("docstring"))
_ORDER_DEFS = lambda s, d: table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.when(F.col("l_returnflag") == "R", "class").otherwise("function").alias("kind"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_linenumber").cast("long").alias("start_line"), (F.col("l_suppkey") % 2).alias("depth"))
_SHAPE = "CASE WHEN nc > nf THEN 'Class definitions' WHEN nf > 0 THEN 'Function implementations' ELSE 'Source file' END"
R.add(
    "c7_file_summaries",
    lambda s, d: c.file_summaries(_ORDER_FILES(s, d), _ORDER_DEFS(s, d)),
    f"""WITH o AS (SELECT o_orderkey AS k, (['test_a.py', 'x_model.py', 'thing.py'])[o_orderkey % 3 + 1] AS name, o_orderkey % 40 AS lines, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS doc FROM orders),
    g AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag <> 'R') AS nf, count(*) FILTER (WHERE l_returnflag = 'R') AS nc, coalesce(list('f' || l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_suppkey % 2 = 0), []) AS ex FROM lineitem GROUP BY 1),
    j AS (SELECT o.*, coalesce(nf, 0) AS nf, coalesce(nc, 0) AS nc, coalesce(ex, []) AS ex FROM o LEFT JOIN g USING (k))
    SELECT CAST(k AS VARCHAR) AS path, 'File: ' || k || chr(10) || 'Purpose: ' || CASE name WHEN 'test_a.py' THEN 'Test file' WHEN 'x_model.py' THEN 'Data model definitions' ELSE {_SHAPE} END || chr(10) || chr(10) || 'Components:' || chr(10) || '- ' || nf || ' functions' || chr(10) || '- ' || nc || ' classes' || chr(10)
    || CASE WHEN len(ex) > 0 THEN chr(10) || 'Main exports: ' || array_to_string(ex[1:10], ', ') || CASE WHEN len(ex) > 10 THEN chr(10) || '  (' || (len(ex) - 10) || ' more)' ELSE '' END || chr(10) ELSE '' END || CASE WHEN doc IS NOT NULL THEN chr(10) || doc ELSE '' END AS content, greatest(lines, 1) AS end_line FROM j""",
)
_CLASSES = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.concat(F.lit("K"), F.col("o_orderkey").cast("string"), F.lit("Manager")).alias("class_name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("docstring"), F.lit(1).alias("start_line"), (F.col("o_orderkey") % 150).alias("end_line"))
_METHODS = lambda s, d: table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit("K"), F.col("l_orderkey").cast("string"), F.lit("Manager")).alias("class_name"), F.concat(F.when(F.col("l_returnflag") == "R", "_").otherwise(""), F.lit("m"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_linenumber") % 2 == 0, F.repeat(F.lit("word "), F.col("l_linenumber") * 3)).alias("docstring"), F.col("l_linenumber").alias("start_line"))
R.add(
    "c8_class_summaries",
    lambda s, d: c.class_summaries(_CLASSES(s, d), _METHODS(s, d)),
    """WITH m AS (SELECT l_orderkey AS k, l_linenumber AS i, l_returnflag = 'R' AS hidden, CASE WHEN l_returnflag = 'R' THEN '_' ELSE '' END || 'm' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN repeat('word ', l_linenumber * 3) END AS doc FROM lineitem),
    g AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE hidden) AS h, coalesce(list('- ' || name || CASE WHEN doc IS NULL THEN '' WHEN length(doc) > 60 THEN ': ' || left(doc, 57) || '...' ELSE ': ' || doc END ORDER BY i) FILTER (WHERE NOT hidden), []) AS l FROM m GROUP BY k),
    o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS doc, o_orderkey % 150 AS e, coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(l, []) AS l FROM orders LEFT JOIN g ON k = o_orderkey)
    SELECT CAST(k AS VARCHAR) AS path, 'K' || k || 'Manager' AS class_name, 'Class: K' || k || 'Manager' || chr(10) || 'Purpose: ' || coalesce(doc, 'Management class') || chr(10) || chr(10) || 'Key methods:' || CASE WHEN len(l) > 0 THEN chr(10) || array_to_string(l[1:5], chr(10)) ELSE '' END
    || CASE WHEN len(l) > 5 THEN chr(10) || '- ' || (len(l) - 5) || ' more public methods' ELSE '' END || chr(10) || chr(10) || 'Total: ' || len(l) || ' public, ' || h || ' private methods' AS content FROM o WHERE n > 5 OR e > 100""",
)
_PARTS = lambda s, d, kind: table(s, d, "lineitem").filter(F.col("l_returnflag") == kind).select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("start_line"), F.lit("k" + kind).alias("chunk_type"), F.col("l_partkey").cast("string").alias("content"))
R.add(
    "c9_assemble_chunks",
    lambda s, d: c.assemble_chunks(_PARTS(s, d, "R"), _PARTS(s, d, "A"), _PARTS(s, d, "N")),
    """SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_linenumber AS BIGINT) AS start_line, 'k' || l_returnflag AS chunk_type, CAST(l_partkey AS VARCHAR) AS content,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, CAST(l_partkey AS VARCHAR)) AS place FROM lineitem""",
)
R.add(
    "c10_parse_guard",
    lambda s, d: c.parse_guard(table(s, d, "orders").select(F.col("o_custkey").alias("repository"), (F.col("o_orderkey") % 3 == 0).alias("failed"), (F.col("o_orderkey") % 5).alias("chunks"))),
    """WITH g AS (SELECT o_custkey AS repository, count(*) AS files, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS errors, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 END) AS c FROM orders GROUP BY 1)
    SELECT repository, files, errors, CASE WHEN errors = files THEN 'every file failed' WHEN errors > 0 AND c = 0 THEN 'no chunks' WHEN errors > 0.5 * files THEN 'most files failed' END AS refusal FROM g""",
)
R.add(
    "c11_distinct_content",
    lambda s, d: c.distinct_content(fixed(s, d)).select("content_hash", "path", "start_line"),
    f"WITH {_spans_sql(SIZE, OVERLAP)} SELECT sha256(content) AS content_hash, path, start_line FROM chunks QUALIFY row_number() OVER (PARTITION BY sha256(content) ORDER BY path, start_line) = 1",
)


def _embedded(s, d):
    """Of the contents a quarter has a vector of this model already, and another quarter one of another model."""
    texts = c.distinct_content(fixed(s, d)).select("content_hash", F.col("content").alias("text"))
    first = F.substring("content_hash", 1, 1)
    known = texts.filter(first < "8").select("content_hash", F.when(first < "4", "hash-64").otherwise("other").alias("embedding_model"))
    return c.embed_batches(texts, known).select("content_hash", "embedding_model", F.size("embedding").cast("long").alias("dims"))


R.add("c12_embed_batches", _embedded,
      f"WITH {_spans_sql(SIZE, OVERLAP)} SELECT DISTINCT sha256(content) AS content_hash, 'hash-64' AS embedding_model, CAST(64 AS BIGINT) AS dims FROM chunks WHERE left(sha256(content), 1) >= '4'")


def _attached(s, d):
    own = fixed(s, d).withColumn("content_hash", F.sha2("content", 256))
    have, lack = c.attach_vectors(own, own.filter(F.substring("content_hash", 1, 1) < "c").select("content_hash", F.length("content").alias("v")).distinct())
    return have.groupBy("repository").agg(F.count(F.lit(1)).alias("with_vector")).join(lack.groupBy("repository").agg(F.count(F.lit(1)).alias("without")), "repository", "full")


R.add(
    "c13_attach_vectors",
    _attached,
    f"""WITH {_spans_sql(SIZE, OVERLAP)}, h AS (SELECT repository, left(sha256(chunks.content), 1) < 'c' AS v FROM chunks JOIN files USING (doc_id))
    SELECT repository, nullif(count(*) FILTER (WHERE v), 0) AS with_vector, nullif(count(*) FILTER (WHERE NOT v), 0) AS without FROM h GROUP BY 1""",
)
R.add(
    "c14_ingest_stats",
    lambda s, d: c.ingest_stats(files(s, d).select("repository", (F.col("doc_id") % 7 == 0).alias("failed")), fixed(s, d).select("repository", F.sha2("content", 256).alias("content_hash"), (F.length("content") > 2000).alias("truncated"))),
    f"""WITH {_spans_sql(SIZE, OVERLAP)}, f AS (SELECT repository, count(*) AS files, count(*) FILTER (WHERE doc_id % 7 = 0) AS errors FROM files GROUP BY 1),
    g AS (SELECT repository, count(*) AS chunks, count(DISTINCT sha256(chunks.content)) AS embedded, count(*) FILTER (WHERE length(chunks.content) > 2000) AS truncated FROM chunks JOIN files USING (doc_id) GROUP BY 1)
    SELECT repository, files, errors, coalesce(chunks, 0) AS chunks, coalesce(embedded, 0) AS embedded, coalesce(truncated, 0) AS truncated FROM f LEFT JOIN g USING (repository)""",
)
R.add(
    "p13_apply_caps",
    lambda s, d: c.apply_caps(
        files(s, d).select("repository", F.octet_length("content").cast("long").alias("bytes")), files(s, d).filter("doc_id % 3 = 0").select("repository"),
        {"expanded_bytes": 120_000, "file_bytes": 20_000, "chunks": 3},
    ),
    f"""WITH files AS ({FILES}), g AS (SELECT repository, sum(octet_length(encode(content))) AS bytes, max(octet_length(encode(content))) AS largest, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS chunks FROM files GROUP BY 1)
    SELECT repository, CASE WHEN bytes > 120000 THEN 'expanded_bytes' WHEN largest > 20000 THEN 'file_bytes' WHEN n > 20000 THEN 'files' WHEN chunks > 3 THEN 'chunks' END AS refusal FROM g""",
)
R.add("p11_filter_results", lambda s, d: fixed(s, d).filter((F.col("chunk_type") == "fixed_size") & (F.col("repository") == "src0")).select("path", "start_line"), f"WITH {_spans_sql(SIZE, OVERLAP)} SELECT path, start_line FROM chunks WHERE path LIKE 'src0/%'")
