"""Text, array, hash and number expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: The shapes of quoted terms, identifiers, tokens and credentials.
QUOTED = r""""[^"]+"|'[^']+'"""
PASCAL = r"[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*"
CAMEL = r"[a-z]+[A-Z][a-zA-Z0-9]*"
SNAKE = r"[a-z_][a-z0-9_]{2,}"
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
CREDENTIAL = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|github_pat_[A-Za-z0-9_]+|gh[psuor]_[A-Za-z0-9]+"
    r"|sk-[A-Za-z0-9_-]+|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"
)
REDACTED, CUT_MARK, MOST_CHARS = "[REDACTED]", "... [truncated]", 2000
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
PROMPT_PRICE, COMPLETION_PRICE = 0.15, 0.60
EMBED_PRICES = {"large": 0.10, "small": 0.02}
BACKOFF_BASE, BACKOFF_FACTOR, BACKOFF_CAP, BACKOFF_EXPONENT = 60, 4, 3600, 16


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable isn't repeated where the optimiser inlines columns."""
    return F.transform(F.array(value), use)[0]


def parse_query(text: Column) -> Column:
    """struct(raw_query, quoted_terms, identifiers, clean_query). Word borders are ASCII."""
    found = F.regexp_extract_all(text, F.lit(f"({QUOTED})"), F.lit(1))
    quoted = F.transform(found, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    names = F.concat(*(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_])({p})(?![A-Za-z0-9_])"), F.lit(1)) for p in (PASCAL, CAMEL, SNAKE)))
    clean = F.trim(F.regexp_replace(text, QUOTED, ""))
    return F.struct(text.alias("raw_query"), quoted.alias("quoted_terms"), F.array_distinct(names).alias("identifiers"), clean.alias("clean_query"))


def contains_any(text: Column, terms: Column) -> Column:
    """Any term, without regard to case; nothing is found in or by nulls and empty lists."""
    lower = F.lower(text)
    return F.coalesce(F.exists(terms, lambda t: F.contains(lower, F.lower(t))), F.lit(False))


def breadcrumb(ancestors: Column, name: Column) -> Column:
    levels = F.filter(F.concat(F.coalesce(ancestors, F.array().cast("array<string>")), F.array(name)), lambda p: F.coalesce(p != "", F.lit(False)))
    return F.array_join(F.slice(levels, F.greatest(F.size(levels) - 3, F.lit(1)), F.lit(4)), ".")


def embedding_text(crumb: Column, docstring: Column, content: Column) -> Column:
    some = lambda c, out: F.when(F.length(c) > 0, out)
    parts = F.array(some(crumb, F.concat(F.lit("# "), crumb)), some(docstring, F.concat(F.lit('"""'), docstring, F.lit('"""'))), content)
    return F.array_join(F.array_compact(parts), "\n\n")


def split_lines(text: Column) -> Column:
    """Lines without their breaks; no line after a last break, none in an empty text."""

    def cut(lines: Column) -> Column:
        return F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)

    return bind(F.split(text, LINE_BREAK, -1), cut)


def content_preview(text: Column, chars: int = 200) -> Column:
    return F.substring(text, 1, chars)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def query_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def vector_hash(vector: Column) -> Column:
    """SHA-256 over the components, as doubles to nine places, joined by commas."""
    return F.sha2(F.array_join(F.transform(vector, lambda v: F.format_string("%.9f", v.cast("double"))), ","), 256)


def redact(text: Column) -> Column:
    """NULs dropped, credentials replaced, at most 2000 characters."""
    clean = F.regexp_replace(F.translate(text, "\x00", ""), CREDENTIAL, REDACTED)
    return F.when(F.length(clean) > MOST_CHARS, F.concat(F.substring(clean, 1, MOST_CHARS - len(CUT_MARK)), F.lit(CUT_MARK))).otherwise(clean)


def redact_json(values: Column) -> Column:
    """``redact`` over every key and value of a map of strings. Keys that become equal keep the last value."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct(redact(e["key"]).alias("key"), redact(e["value"]).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def redact_nested(value: Column, kind: DataType) -> Column:
    """``redact`` over every string in a value of type ``kind``: leaves of structs, arrays and maps at any depth, and keys of maps.

    A map's keys that become equal keep the last value. Fields of structs keep their names; other leaves stay as they are.
    """
    if isinstance(kind, StringType):
        return redact(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: redact_nested(v, kind.elementType))
    if isinstance(kind, StructType):
        own = F.struct(*(redact_nested(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), own)
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(redact_nested(e["key"], kind.keyType).alias("key"), redact_nested(e["value"], kind.valueType).alias("value")))
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
        return F.map_from_entries(last)
    return value


def redact_json_text(text: Column) -> Column:
    """JSON text with ``redact`` over every string in it, keys included, whatever its shape; its numbers, marks and blanks stay as they are."""
    parts = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*"|[^"]+)'), F.lit(1))
    inner = lambda p: F.concat(F.lit('"'), redact(F.substring(p, F.lit(2), F.length(p) - 2)), F.lit('"'))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"') & (F.length(p) > 1), inner(p)).otherwise(p)), "")


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def count_tokens(text: Column) -> Column:
    return F.size(token_list(text)).cast("long")


def truncate_tokens(text: Column, most: int) -> Column:
    """The text up to its ``most``-th token; a text of no more tokens is unchanged."""
    upto = F.regexp_extract(text, rf"^((?:(?:{TOKEN})\s*?|\s*?(?:{TOKEN})){{{most}}})", 1)
    return F.when(count_tokens(text) > most, upto).otherwise(text)


def llm_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return (prompt_tokens * PROMPT_PRICE + completion_tokens * COMPLETION_PRICE) / 1_000_000


def embed_cost(tokens: Column, kind: str) -> Column:
    return tokens * EMBED_PRICES[kind] / 1_000_000


def backoff_seconds(attempts: Column) -> Column:
    """Upper end of the wait before the next attempt; the lower end is half of it."""
    exponent = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(BACKOFF_EXPONENT))
    return F.least(BACKOFF_BASE * F.pow(F.lit(BACKOFF_FACTOR), exponent), F.lit(float(BACKOFF_CAP)))


def jittered_backoff(attempts: Column, job_id: Column) -> Column:
    """A wait in [half, whole) of ``backoff_seconds``, the same for the same job and attempt."""
    share = F.pmod(F.xxhash64(job_id, attempts), F.lit(1_000_000)) / 1_000_000
    return backoff_seconds(attempts) * (0.5 + share / 2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """In doubles; 0 where a norm is 0."""
    over = norm(a) * norm(b)
    return F.when(over == 0, 0.0).otherwise(dot(a, b) / F.nullif(over, F.lit(0.0)))


def module_docstring(content: Column) -> Column:
    """The first triple-quoted text after leading ``#`` lines; lines joined by spaces."""
    body = F.regexp_extract(F.trim(content), r"""(?s)^(?:[ \t]*#[^\n]*\n)*[ \t]*(""\"|''')(.*?)(?:\1|\z)""", 2)
    has = F.trim(content).rlike(r"""^(?:[ \t]*#[^\n]*\n)*[ \t]*(""\"|''')""")
    return F.when(has, F.trim(F.regexp_replace(body, "\n", " ")))


def path_matches(path: Column, expected: Column) -> Column:
    return (path == expected) | F.contains(path, expected)


def symbol_matches(crumb: Column, symbol: Column) -> Column:
    return (crumb == symbol) | F.endswith(crumb, F.concat(F.lit("."), symbol))
