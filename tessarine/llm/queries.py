"""The subpackage's registered queries, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.llm.collocations import collocations
from tessarine.llm.chat import INSTRUCTIONS, PART_TURNS, rotate_perspectives
from tessarine.llm.html import extract_text
from tessarine.llm.lm import score_documents
from tessarine.llm.mixing import plan_mix
from tessarine.llm.near_dedup import near_duplicates
from tessarine.llm.packing import pack_documents
from tessarine.llm.pii import personal_data
from tessarine.llm.quality import RULES, STOP_WORDS, quality_verdicts
from tessarine.llm.search import TERM, ranked_search
from tessarine.llm.substring import remove_repeats
from tessarine.llm.topk import top_k
from tessarine.llm.warc import LEAST_BYTES, archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the box keeps public tokenizers, unless TESSARINE_TOKENIZER names another file."""
    if own := os.environ.get("TESSARINE_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path(name)


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": _over("documents", near_duplicates),
        "op2_quality_rules": _over("documents", quality_verdicts),
        "op3_substring_dedup": _over("documents", lambda docs: remove_repeats(docs).select("row.doc_id", "text", "spans", "copied_from")),
        "op4_best_fit_packing": _over("documents", lambda docs: pack_documents(docs, tokenizer_path())),
        "op5_lm_scores": _over("documents", score_documents),
        "op6_warc_round_trip": _over("pages", archive_round_trip),
        "op7_perspectives": _over("conversations", lambda turns: rotate_perspectives(turns).select("conv_id", "speaker", "part", "piece", "n_turns", "text", F.col("spans.start").alias("span_starts"), F.col("spans.end").alias("span_ends"))),
        "op8_mixing": _over("documents", plan_mix),
        "op9_html_text": _over("pages", extract_text),
        "op10_exact_top_k": _over("embeddings", top_k),
        "op11_collocations": _over("documents", collocations),
        "op12_personal_data": _over("documents", personal_data),
        "op13_ranked_search": lambda spark, sf_dir: ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "pipeline": _pipeline,
    }


_STOPS = "(" + ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS)) + ")"
_QUALITY = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(bare) AS BIGINT) AS word_chars, CAST(length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(list_filter(w, lambda x: lower(x) IN {_STOPS})) AS BIGINT) AS n_stop_words, CAST(length(bare) - length(regexp_replace(bare, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(bare) - length(replace(bare, '!', '')) AS BIGINT) AS n_shouts FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND """ + " AND ".join(f"{r.denominator} > 0 AND {r.numerator} >= {r.low}e0 * {r.denominator} AND {r.numerator} <= {r.high}e0 * {r.denominator}" for r in RULES) + " AS kept FROM b"  # fmt: skip

_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {LEAST_BYTES} GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h AND n >= {LEAST_BYTES}"""

_SAFE = "replace(coalesce({}, '{}'), '<|', '<\\|')"
_CHAT = f"""WITH people AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role <> '{INSTRUCTIONS}'),
t AS (SELECT conv_id, speaker, CAST(coalesce(floor(turn / {PART_TURNS}), 0) AS BIGINT) AS part, turn, role, '<|' || CASE WHEN role = speaker THEN 'assistant' WHEN role = '{INSTRUCTIONS}' THEN 'system' ELSE 'user name=' || {_SAFE.format('role', 'unknown')} END || '|>' || chr(10) AS head,
  {_SAFE.format('text', '')} || chr(10) || '<|end|>' || chr(10) AS body, coalesce(role = speaker, false) AS trained, piece
  FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id, coalesce(floor(turn / {PART_TURNS}), 0) ORDER BY turn NULLS FIRST, role NULLS FIRST, {_SAFE.format('text', '')}) - 1) // {PART_TURNS} AS piece FROM conversations) JOIN people USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY turn NULLS FIRST, role NULLS FIRST, body ROWS UNBOUNDED PRECEDING) AS stop FROM t)
SELECT conv_id, speaker, part, piece, count(*) AS n_turns, string_agg(head || body, '' ORDER BY stop) AS text,
  coalesce(list(CAST(stop - length(body) AS BIGINT) ORDER BY stop) FILTER (WHERE trained), []) AS span_starts, coalesce(list(CAST(stop AS BIGINT) ORDER BY stop) FILTER (WHERE trained), []) AS span_ends FROM o GROUP BY conv_id, speaker, part, piece"""

_MIX = rf"""WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 10) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
l AS (SELECT *, 1.5e0 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS others FROM s
  WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min(rest / others) AS level FROM (SELECT rest, others FROM l WHERE 2 * source_size > weight * (rest / others) ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST LIMIT 1)),
t AS (SELECT source, source_size, least(2e0 * source_size, coalesce(weight * level, 2e0 * source_size)) AS target FROM s, v),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (rounds + CASE WHEN rounds < 2 AND source_size > 0 AND upto <= target - rounds * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c"""

_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.t) + 1), lambda i: q.t[i] * c.t[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PHRASES = rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m)),
size AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM g) GROUP BY lang, m, phrase HAVING count(*) >= 100),
p AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
c AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM p)),
s AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y JOIN size ON size.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT lang, a, array_to_string(w[j:j + o - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - o + 2)) AS j FROM p JOIN (SELECT unnest([2, 3, 4]) AS o) ON o < m))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b ANTI JOIN d USING (lang, phrase, a) QUALIFY rank <= 2000"""

_RANKED = rf"""WITH t AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM t WHERE len(w) > 0),
m AS (SELECT d, doc_id, 50 + (50 * len(w) * s.n) // s.l AS m FROM t, s WHERE len(w) > 0),
f AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM t) GROUP BY d, term),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}'))) AS term FROM benchmark),
p AS (SELECT item_id, d, CAST(floor(1000 * ln((2e0 * n + 2) / (2e0 * df + 1))) AS BIGINT) AS w, tf FROM q JOIN df ON df.term = q.term JOIN f ON f.term = q.term, s),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM p JOIN m ON m.d = p.d GROUP BY item_id, p.d, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can say the same; the others are tested against brute force in tests/llm."""
    return {"op2_quality_rules": _QUALITY, "op6_warc_round_trip": _WARC, "op7_perspectives": _CHAT, "op8_mixing": _MIX, "op10_exact_top_k": _TOP_K, "op11_collocations": _PHRASES, "op13_ranked_search": _RANKED}
