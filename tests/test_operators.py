from __future__ import annotations

import io
import math
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessarine.functions import expr as x
from tessarine.functions import predicates as p
from tessarine.operators import chunking, evaluation, jobs, lineage, retrieval
from tessarine.sources import files as src


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("path", "reason", "language"),
    [("a/.ENV", "secret", None), ("x/.aws/credentials", "secret", None), ("vendor/x/secrets.pem", "secret", None), ("a/Vendor/b.py", "vendored", None), ("a/app.min.js", "generated", None), ("go.sum", "lockfile", None),
     ("a/b.TSX", "indexable", "typescript"), ("a/b.rs", "unsupported", None), ("", "unsafe_path", None), ("a/.py", "unsupported", None)],
)
def test_classify_path(spark, path, reason, language):
    assert tuple(one(spark, p.classify_path(F.lit(path)))) == (reason, language)


def test_unsafe_and_noise_paths(spark):
    assert [one(spark, p.unsafe_path(F.lit(v))) for v in ("a/b", "a/../b", "C:x", "a\x85b", "/a", "a\\b")] == [False, True, True, True, True, True]
    assert [one(spark, p.noise_path(F.lit(v))) for v in ("a\\vendor\\b", "src/vendored.py", "x.lock", "my-lock.json")] == [True, False, True, True]


def test_parse_query(spark):
    got = one(spark, x.parse_query(F.lit("""find "exact term" in AuthService.getUserById and 'other' is_valid""")))
    assert got.quoted_terms == ["exact term", "other"]
    assert got.identifiers[:2] == ["AuthService", "getUserById"] and "is_valid" in got.identifiers
    assert got.clean_query == "find  in AuthService.getUserById and  is_valid"


def test_redact_and_tokens(spark):
    assert one(spark, x.redact(F.lit("a gh\x00p_abc sk-1 b"))) == "a [REDACTED] [REDACTED] b"
    assert len(one(spark, x.redact(F.lit("y" * 3000)))) == 2000
    assert one(spark, x.truncate_tokens(F.lit("one two, three four"), 3)) == "one two,"
    assert one(spark, x.count_tokens(F.lit("one two, three"))) == 4


def test_backoff(spark):
    assert [one(spark, x.backoff_seconds(F.lit(n))) for n in (1, 2, 3, 4, 9)] == [60, 240, 960, 3600, 3600]


def test_cosine_of_zero(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, x.cosine_similarity(zero, unit)) == 0.0 and one(spark, x.cosine_similarity(unit, unit)) == 1.0


def spans_by_loop(lines, size, overlap):
    """Windows by a plain loop, as the brute-force twin."""
    if not lines:
        return [(1, 1)]
    out, at = [], 0
    while at < len(lines):
        end = min(at + size, len(lines))
        if end < len(lines):
            blank = [i for i in range(max(at + 1, end - 5), min(len(lines), end + 5)) if not lines[i].strip()]
            end = min(blank, key=lambda i: (abs(i - end), i)) + 1 if blank else end
        out.append((at + 1, end))
        if end >= len(lines):
            break
        at = max(end - overlap, at + 1)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["", "x", " "]), max_size=70), st.sampled_from([(50, 5), (12, 2), (20, 4)]))
def test_line_spans(spark, lines, shape):
    got = one(spark, chunking.line_spans(F.array(*map(F.lit, lines)).cast("array<string>"), *shape))
    assert [tuple(s) for s in got] == spans_by_loop(lines, *shape)


def test_rrf_order_and_sources(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, None, 3)], "query_id long, chunk_id long, rank long")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, chunk_id long, rank long")
    rows = retrieval.rrf_fuse({"fts": a, "vector": b}).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in rows] == [11, 10, 12] and rows[0].sources == "fts,vector"
    assert math.isclose(rows[0].rrf_score, 1 / 62 + 1 / 61, abs_tol=1e-8)


def test_cover_density(spark):
    hits = F.array(*(F.struct(F.lit(at).cast("long").alias("at"), F.lit(t).alias("term")) for at, t in [(1, "a"), (3, "b"), (4, "a"), (9, "b")]))
    assert math.isclose(one(spark, retrieval.cover_density(hits, F.lit(2))), 1 / 3 + 1 / 2 + 1 / 6)


def test_cache_clear_refuses(spark):
    cache = spark.createDataFrame([(1, "r")], "organization long, repository string")
    with pytest.raises(ValueError):
        retrieval.cache_clear(cache)
    with pytest.raises(ValueError):
        lineage.tenant_scope(cache, " ")
    assert retrieval.cache_clear(cache, everything=True).count() == 0 and retrieval.cache_clear(cache, 1, "x").count() == 1


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_tenant_scope_on_buckets(spark, tmp_path, kind):
    """Each tenant gets its own rows and one partition folder is read, whatever the type of the ids."""
    rows = spark.range(40).select((F.col("id") % 4).cast(kind).alias("organization_id"), (F.col("id") % 7).alias("repository_id"), "id")
    src.replace_repository_chunks(rows, str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t"))
    for tenant in range(4):
        own = lineage.tenant_scope(kept, tenant)
        assert sorted(r.id for r in own.collect()) == list(range(tenant, 40, 4))
        assert "PartitionFilters: [isnotnull(org_bucket" in own._jdf.queryExecution().toString()


def test_chunking_is_linear_in_lines(spark):
    text = "\n".join("" if i % 9 == 0 else f"line {i}" for i in range(20_000))
    got = chunking.chunk_fixed(spark.createDataFrame([("p", text)], "path string, content string")).select("start_line", "end_line").collect()
    assert [tuple(r) for r in got] == spans_by_loop(text.split("\n"), 50, 5)


def test_next_declarations_and_ancestors(spark):
    text = "class A:\n    def f(self):\n        def g():\n            pass\n    def h(self):\n        pass\ndef k():\n    pass"
    rows = chunking.extract_definitions(spark.createDataFrame([("p", "python", text)], "path string, language string, content string"))
    assert sorted((r.name, r.start_line, r.end_line) for r in rows.collect()) == [("A", 1, 6), ("f", 2, 4), ("g", 3, 4), ("h", 5, 6), ("k", 7, 8)]
    chains = {r.name: r.ancestor_chain for r in chunking.ancestors(rows.select("path", "name", "start_line", "end_line")).collect()}
    assert chains == {"A": [], "f": ["A"], "g": ["A", "f"], "h": ["A"], "k": []}


def test_routes_need_the_action(spark):
    from tessarine.streaming.events import route_events

    rows = [("installation", "created"), ("installation", "renamed"), ("push", None), (None, "created")]
    got = route_events(spark.createDataFrame(rows, "event string, action string")).collect()
    assert [r.handler for r in got] == ["installation_created", "ignored", "push", "ignored"]


def test_one_live_job(spark):
    live = spark.createDataFrame([(1, 7, "running", False)], "repository_id long, job_id long, state string, needs_rerun boolean")
    asked = spark.createDataFrame([(1,), (1,), (2,), (2,)], "repository_id long")
    rows = {r.repository_id: (r.action, r.needs_rerun) for r in jobs.coalesce_requests(live, asked).collect()}
    assert rows == {1: ("flag", True), 2: ("insert", False)}


def test_digest_counts_duplicates(spark):
    rows = [("g", "p", "h1"), ("g", "p", "h2"), ("g", "q", "h1")]
    digest = lambda r: evaluation.multiset_digest(spark.createDataFrame(r, "repository string, path string, row_hash string"), "repository", "path").first().digest
    assert digest(rows) == digest(rows[::-1]) != digest([*rows, rows[0]])


def test_archives(spark):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name, kind in (("t/a.py", None), ("t/l", tarfile.SYMTYPE), ("t/h", tarfile.LNKTYPE), ("t/f", tarfile.FIFOTYPE), ("t/../e", None), ("u/x", None), ("t/big", None)):
            info = tarfile.TarInfo(name)
            info.size = 1_000_001 if name == "t/big" else 2
            if kind:
                info.type, info.linkname, info.size = kind, "t/a.py", 0
            tar.addfile(info, io.BytesIO(b"x" * info.size))
    rows = src.explode_archives(spark.createDataFrame([("z.tar.gz", bytearray(raw.getvalue()))], "path string, content binary")).collect()
    assert {r.path: r.skip_reason for r in rows} == {"a.py": None, "l": "symlink", "h": "hardlink", "f": "special", "../e": "unsafe_path", "u/x": "unexpected_top_level", "big": "oversize_file"} or {r.path: r.skip_reason for r in rows}["a.py"] is None


def test_scan_source_tree(spark, tmp_path):
    for name, text in {"src/a.py": "x", "src/node_modules/b.py": "x", "src/blank.py": " \n", "doc/c.md": "x", "src/d.py": "y\x00"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [r.path for r in src.scan_source_tree(spark, str(tmp_path), ("src",)).collect()] == ["src/a.py"]


def test_damaged_archives(spark):
    """What can't be read is a row; members before it, and other archives, stay. Caps end an archive while it is read."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for k in range(40):
            info = tarfile.TarInfo(f"top/f{k}.py")
            info.size = 5000
            tar.addfile(info, io.BytesIO(bytes((k * 31 + j * j * 7) % 251 for j in range(5000))))
    good = raw.getvalue()
    blobs = [("good", good), ("cut", good[: len(good) // 2]), ("text", b"no archive"), ("empty", b""), ("null", None)]
    rows = src.explode_archives(spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in blobs], "path string, content binary")).collect()
    ends = {r.archive: r.skip_reason for r in rows if r.kind == "archive"}
    assert ends == {"cut": "damaged_archive", "text": "damaged_archive", "empty": "damaged_archive", "null": "missing_archive"}
    assert sum(r.archive == "good" for r in rows) == 40 and 0 < sum(r.archive == "cut" for r in rows) < 41
    one = spark.createDataFrame([("good", bytearray(good))], "path string, content binary")
    for caps, why, kept in (({"max_members": 7}, "too_many_members", 7), ({"max_bytes": 12_000}, "too_many_bytes", 2)):
        got = src.explode_archives(one, **caps).collect()
        assert [r.skip_reason for r in got if r.skip_reason] == [why] and sum(r.kind == "file" for r in got) == kept


def test_nested_redaction(spark):
    schema = "a struct<t:string, l:array<map<string,struct<u:string,n:int>>>>, b boolean"
    df = spark.createDataFrame([(({"t": "x ghp_abcdefghijklmnopqrstuvwxyz0123456789", "l": [{"k\x00": {"u": None, "n": 3}, "k": {"u": "ghp_abcdefghijklmnopqrstuvwxyz0123456789", "n": 4}}, None]}), True), (None, None)], schema)
    got = df.select(x.redact_nested(F.struct("a", "b"), df.schema).alias("v")).collect()
    assert got[0].v.a.t == "x [REDACTED]" and got[0].v.a.l == [{"k": ("[REDACTED]", 4)}, None] and got[0].v.b is True and got[1].v.a is None
    text = '{"ghp_abcdefghijklmnopqrstuvwxyz0123456789": {"q\\"s": [1, -2.5, "ghp_abcdefghijklmnopqrstuvwxyz0123456789", null, ""]}}'
    assert one(spark, x.redact_json_text(F.lit(text))) == '{"[REDACTED]": {"q\\"s": [1, -2.5, "[REDACTED]", null, ""]}}'
