"""Files, archives, run records and chunk sets in and out of Spark."""

from __future__ import annotations

import collections
import gzip
import io
import itertools
import os
import re
import tarfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.operators.lineage import tenant_bucket

SKIP_DIRS = r"(^|/)(node_modules|vendor|dist|build|\.git|__pycache__|third_party)/"
MAX_FILE = 1_000_000
MEMBER = "archive string, path string, size long, content binary, kind string, skip_reason string"


FIRST_FOLDERS = 1000
"""Folders of a tree that the driver looks for; tasks walk what is below them."""


def scan_source_tree(spark: SparkSession, root: str, roots: tuple[str, ...] = ("",), extensions: tuple[str, ...] = (".py", ".go", ".ts", ".tsx", ".js"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of text files below ``root``: by extension, without skipped directories, excluded patterns and blank files.

    Paths are relative to ``root`` and separated by ``/``. Where Hadoop's local file system holds ``root``, in a folder that driver and
    executors share, tasks list and read the files, and the driver sees folders alone; linked folders are not entered. Elsewhere Spark
    lists them, on the driver, without names that begin with ``_`` or ``.``.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    local = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | F.col("path").endswith(e)
    below = F.lit(False)
    for r in roots:
        below = below | F.lit(r == "") | F.col("path").startswith(r.rstrip("/") + "/")
    wanted = wanted & below & ~F.col("path").rlike(SKIP_DIRS)
    for pattern in exclude:
        wanted = wanted & ~F.col("path").rlike(pattern)
    rows = _local_files(spark, os.path.abspath(at.toUri().getPath()), roots, wanted) if local else _listed_files(spark, root).filter(wanted)
    return decode_text(rows).filter("skip_reason is null").select("path", F.col("text").alias("content")).filter(F.trim(F.regexp_replace("content", r"\s", "")) != "")


def _listed_files(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(base) + "/", "")
    return raw.select(path.alias("path"), "content")


def _local_files(spark: SparkSession, base: str, roots: tuple[str, ...], wanted: Column) -> DataFrame:
    """(path, content) of the ``wanted`` files: folders are dealt to tasks that list them, and the files to tasks that read them."""
    top, starts = os.fsencode(base.rstrip("/")), ["" if r == "" else r.rstrip("/") + "/" for r in roots]

    def relative(file: bytes) -> str:
        return file[len(top) + 1 :].decode("utf-8", "replace")

    def enter(folder: bytes) -> bool:
        own = relative(folder) + "/"
        return not re.search(SKIP_DIRS, own) and any(own.startswith(r) or r.startswith(own) for r in starts)

    def folders(at: bytes) -> list[bytes]:
        with os.scandir(at) as entries:
            return [e.path for e in entries if e.is_dir(follow_symlinks=False) and enter(e.path)]

    def files_in(at: bytes) -> Iterator[bytes]:
        with os.scandir(at) as entries:
            yield from (e.path for e in entries if e.is_file())

    def walk(at: bytes) -> Iterator[bytes]:
        yield from files_in(at)
        for folder in folders(at):
            yield from walk(folder)

    def names(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for folder, whole in zip(part["folder"], part["whole"], strict=True):
                found = (walk if whole else files_in)(bytes(folder))
                while some := list(itertools.islice(found, 10_000)):
                    yield pd.DataFrame({"path": [relative(f) for f in some], "file": some})

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, size = [], 0
            for path, file in zip(part["path"], part["file"], strict=True):
                with open(bytes(file), "rb") as opened:
                    rows.append((path, opened.read()))
                size += len(rows[-1][1])
                if size > 16 * MAX_FILE:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "content"])

    left, listed = collections.deque([top or b"/"]), []
    while left and len(left) + len(listed) < FIRST_FOLDERS:
        listed.append(left.popleft())
        left.extend(folders(listed[-1]))
    dealt = spark.createDataFrame([(bytearray(f), False) for f in listed] + [(bytearray(f), True) for f in left], "folder binary, whole boolean")
    n, tasks = len(listed) + len(left), int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(min(n, tasks)).mapInPandas(names, "path string, file binary").filter(wanted)
    return found.repartition(max(n, tasks)).mapInPandas(read, "path string, content binary")


FOLDER_FILES = 1000
"""Files of one folder that a task writes; folders beyond 32 are listed by tasks instead of the driver."""


def write_line_files(rows: DataFrame, root: str, by: str) -> None:
    """Each row's ``value`` as a line of its own file ``root/by=.../piece=.../part-*.txt``; ``root`` is new, in a folder that driver and executors share.

    Every folder is one task's, so none is merged when the job ends. Hadoop's local file system starts a process for the
    mode of each new file and its checksum; where it holds ``root``, the tasks write there themselves. A task that runs again writes the same
    files anew. Elsewhere Spark writes them.
    """
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        rows.select(by, F.spark_partition_id().alias("piece"), "value").write.partitionBy(by, "piece").option("maxRecordsPerFile", 1).text(root)
        return
    below = at.toUri().getPath()
    os.makedirs(below, exist_ok=True)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, folder = TaskContext.get().partitionId(), 0, {}
        for part in parts:
            for group, raw in zip(part["by"], part["raw"], strict=True):
                piece = task << 20 | n // FOLDER_FILES
                if folder.get(group, (None,))[0] != piece:
                    folder[group] = piece, f"{below}/{by}={group}/piece={piece}"
                    os.makedirs(folder[group][1], exist_ok=True)
                with open(f"{folder[group][1]}/part-{n}.txt", "wb") as out:
                    out.write(raw + b"\n")
                n += 1
        yield pd.DataFrame({"n": [n]})

    group = F.coalesce(F.col(by), F.lit("__HIVE_DEFAULT_PARTITION__"))
    raw = F.coalesce("value", F.lit("")).cast("binary")
    rows.select(group.alias("by"), raw.alias("raw")).mapInPandas(write, "n long").agg(F.sum("n")).collect()


def member_problem(member: tarfile.TarInfo, name: str) -> str | None:
    if member.issym():
        return "symlink"
    if member.islnk():
        return "hardlink"
    if member.issparse():
        return "sparse"
    if not member.isfile():
        return "special"
    if not name or re.search(r"[\x00-\x1f\x7f-\x9f\\]", name) or re.match(r"[A-Za-z]:|/", name) or any(p in ("", ".", "..") for p in name.split("/")):
        return "unsafe_path"
    return "oversize_file" if member.size > MAX_FILE else None


MAX_MEMBERS, MAX_ARCHIVE = 50_000, 1 << 30
BROKEN = (tarfile.TarError, gzip.BadGzipFile, EOFError, zlib.error, OSError)


def explode_archives(archives: DataFrame, max_members: int = MAX_MEMBERS, max_bytes: int = MAX_ARCHIVE) -> DataFrame:
    """(archive, path, size, content, kind, skip_reason) of every member of ``.tar.gz`` blobs (path, content).

    All members stand under one top directory, which is cut off; others are unexpected_top_level. A skipped member has
    no content. An archive is read as a stream, one member at a time. What can't be read ends its archive, not the job, in a row of
    kind archive without a path: damaged_archive, missing_archive for a null blob, and too_many_members or
    too_many_bytes at the member that goes over a cap; members before it are kept.
    """
    names = ["archive", "path", "size", "content", "kind", "skip_reason"]

    def members(archive: str, blob: bytes) -> Iterator[tuple]:
        top, seen, total = None, 0, 0
        with tarfile.open(fileobj=io.BytesIO(blob), mode="r|gz") as tar:
            for m in tar:
                seen, total = seen + 1, total + m.size
                if seen > max_members or total > max_bytes:
                    yield archive, None, None, None, "archive", "too_many_members" if seen > max_members else "too_many_bytes"
                    return
                head, _, rest = m.name.partition("/")
                top = top or head
                if m.isdir():
                    continue
                why = "unexpected_top_level" if head != top or not rest else member_problem(m, rest)
                yield archive, rest or m.name, m.size, None if why else tar.extractfile(m).read(), "file" if m.isfile() else "other", why

    def whole(archive: str, blob: bytes | None) -> Iterator[tuple]:
        if blob is None:
            yield archive, None, None, None, "archive", "missing_archive"
            return
        try:
            yield from members(archive, blob)
        except BROKEN:
            yield archive, None, None, None, "archive", "damaged_archive"

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, blob in zip(part["path"], part["content"], strict=True):
                rows, size = [], 0
                for row in whole(archive, blob):
                    rows.append(row)
                    size += len(row[3] or b"")
                    if len(rows) == 200 or size > 16 * MAX_FILE:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    return archives.select("path", "content").mapInPandas(read, MEMBER)


def decode_text(df: DataFrame, column: str = "content") -> DataFrame:
    """``df`` with ``text`` and ``skip_reason``: a NUL byte means binary, broken UTF-8 non_utf8; a leading BOM is cut."""
    raw = F.col(column)
    nul = F.contains(raw, F.lit(b"\x00"))
    why = F.when(nul, "binary").when(~F.is_valid_utf8(raw.cast("string")), "non_utf8")
    text = F.regexp_replace(raw.cast("string"), "^﻿", "")
    had = F.col("skip_reason") if "skip_reason" in df.columns else F.lit(None).cast("string")
    return df.withColumn("skip_reason", F.coalesce(had, why)).withColumn("text", F.when(F.col("skip_reason").isNull(), text))


RUN_SCHEMA = (
    "record string, id string, `set` string, path string, symbol string, file_rank long, symbol_rank long, query_vector_sha256 string, error string, commit string, top_k long, "
    "trace struct<fts:array<struct<chunk_id:long,rank:long,score:double>>,vector:array<struct<chunk_id:long,rank:long,score:double>>,fused:array<struct<chunk_id:long,rank:long,score:double>>,top:array<struct<chunk_id:long,rank:long,score:double>>>"
)


def read_run_records(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Header and question rows of JSON-lines run records, gzipped or not. Broken lines are dropped here: ``check_run_records`` tells of them."""
    rows = spark.read.schema(RUN_SCHEMA).option("mode", "DROPMALFORMED").json(paths).withColumn("file", F.input_file_name())
    return rows.filter("record = 'run'"), rows.filter("record is null or record <> 'run'")


#: What a question record must name, and the stages of its trace.
QUESTION_KEYS = ("id", "set", "path", "symbol", "file_rank", "symbol_rank", "query_vector_sha256", "trace", "error")
STAGES = ("fts", "vector", "fused", "boosted", "top")


def read_record_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line) of run records as they are written; blank lines are left out."""
    return spark.read.text(paths).select(F.input_file_name().alias("file"), F.col("value").alias("line")).filter("trim(line) <> ''")


def check_run_records(lines: DataFrame) -> DataFrame:
    """(check, key, detail) of record files (file, line) that are no complete measurement.

    broken_line: no JSON object. no_header, several_headers, no_questions: by file. missing_keys: a question record lacks
    some; the detail names them. missing_stages: its trace lacks some, and it has no error. repeated: an id twice in a file.
    """
    field = lambda name: F.get_json_object("line", f"$.{name}")
    keys = F.json_object_keys("line")
    lack = lambda wanted, there: F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(there, F.array().cast("array<string>")))
    rows = lines.select("file", "line", keys.alias("keys"), F.when(keys.isNotNull(), field("record")).alias("record"), field("id").alias("id"))
    asked = rows.filter("record = 'question'")
    violation = lambda df, name, key, detail: df.select(F.lit(name).alias("check"), key.alias("key"), detail.alias("detail"))
    by_file = rows.groupBy("file").agg(F.count_if(F.col("record") == "run").alias("headers"), F.count_if(F.col("record") == "question").alias("questions"))
    left = asked.withColumn("lack", lack(QUESTION_KEYS, F.col("keys")))
    stages = asked.filter(F.coalesce(field("error"), F.lit("")) == "").withColumn("lack", lack(STAGES, F.json_object_keys(field("trace"))))
    twice = asked.groupBy("file", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = [
        violation(rows.filter("keys is null"), "broken_line", F.col("file"), F.substring("line", 1, 80)),
        violation(by_file.filter("headers = 0"), "no_header", F.col("file"), F.lit("")), violation(by_file.filter("headers > 1"), "several_headers", F.col("file"), F.col("headers").cast("string")),
        violation(by_file.filter("questions = 0"), "no_questions", F.col("file"), F.lit("")), violation(left.filter("size(lack) > 0"), "missing_keys", F.col("id"), F.array_join("lack", ",")),
        violation(stages.filter("size(lack) > 0"), "missing_stages", F.col("id"), F.array_join("lack", ",")), violation(twice, "repeated", F.col("id"), F.col("n").cast("string")),
    ]
    return reduce(DataFrame.unionByName, found)


SPEC_SCHEMA = "corpus string, commit string, roots array<string>, exclude array<string>, questions array<struct<id:string,`set`:string,question:string,path:string,symbol:string,evidence:string>>"


def read_question_specs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per question, with its corpus and commit."""
    spec = spark.read.schema(SPEC_SCHEMA).option("multiLine", True).json(paths)
    return spec.select("corpus", "commit", F.explode("questions").alias("q")).select("corpus", "commit", "q.*")


def read_query_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question_id string, model string, vector array<double>").json(path)


def write_chunk_rows(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def replace_repository_chunks(new: DataFrame, path: str) -> None:
    """Replace the whole chunk set of every repository in ``new`` (organization_id, repository_id, ...); others stay untouched.

    Partitions are (org_bucket, repository_id). A dynamic overwrite moves finished files into place at commit, so a
    failed write leaves the old set.
    """
    rows = new.withColumn("org_bucket", tenant_bucket(F.col("organization_id")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("org_bucket", "repository_id").parquet(path)


def deliveries_in(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """A stream of delivery events from JSON files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)

