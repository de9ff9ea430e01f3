"""Files to chunks: line windows, spans, definitions, summaries and the vectors of distinct content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessarine.functions.expr import bind, content_hash, split_lines
from tessarine.functions.predicates import infer_class_purpose, infer_file_purpose

REACH = 5
#: Declaration lines by language, with the kind and the name.
DEFINITIONS = {
    "python": r"^(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)",
    "go": r"^(\s*)(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "javascript": r"^(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+([A-Za-z_$][\w$]*)",
    "typescript": r"^(\s*)(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface)\s+([A-Za-z_$][\w$]*)",
}
CLASS_KINDS = ("class", "type", "interface")


def blank(line: Column) -> Column:
    return F.regexp_replace(line, r"\s", "") == ""


def blank_line_spans(blanks: Column, size: int = 50, overlap: int = 5) -> Column:
    """``line_spans`` from an array that says of each line whether it is blank; it must be a column or lambda variable."""
    n = F.size(blanks)
    most = F.greatest(F.ceil(n / max(1, size - REACH - overlap + 1)).cast("int") + 1, F.lit(1))

    def cut(start: Column) -> Column:
        want = F.least(start + size, n)
        places = F.sequence(F.greatest(start + 1, want - REACH), F.greatest(F.least(n, want + REACH) - 1, start + 1, want - REACH))
        near = F.filter(places, lambda i: (i < n) & F.get(blanks, i))
        best = F.array_min(F.transform(near, lambda i: F.struct(F.abs(i - want).alias("far"), i.alias("at"))))["at"]
        return F.when(want < n, F.coalesce(best + 1, want)).otherwise(want)

    def step(acc: Column, _: Column) -> Column:
        def ended(e: Column) -> Column:
            span = F.struct((acc["at"] + 1).alias("start"), e.alias("end"))
            at = F.when(e >= n, n).otherwise(F.greatest(e - overlap, acc["at"] + 1))
            return F.struct(at.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.when(acc["at"] >= n, acc).otherwise(bind(cut(acc["at"]), ended))

    none = F.array().cast("array<struct<start:int,end:int>>")
    folded = F.aggregate(F.sequence(F.lit(1), most), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(n == 0, F.array(F.struct(F.lit(1).alias("start"), F.lit(1).alias("end")))).otherwise(folded)


def line_spans(lines: Column, size: int = 50, overlap: int = 5) -> Column:
    """array<struct<start,end>> of 1-based inclusive windows of at most about ``size`` lines.

    A cut moves to just after the blank line nearest to it within five lines, the earlier one on a tie. The next window
    starts ``overlap`` lines before the end. A text without lines is one window 1-1. The fold sees the places of blank
    lines only, so its work grows with the lines and not with their text.
    """
    return bind(F.transform(lines, blank), lambda blanks: blank_line_spans(blanks, size, overlap))


def window_texts(text: Column, size: int = 50, overlap: int = 5) -> Column:
    """array<struct<start,end,text>> of a text's line windows; the text is split once."""

    def cut(lines: Column) -> Column:
        def of_span(span: Column) -> Column:
            own = F.slice(lines, span["start"], span["end"] - span["start"] + 1)
            return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.array_join(own, "\n").alias("text"))

        return F.transform(line_spans(lines, size, overlap), of_span)

    return bind(split_lines(F.coalesce(text, F.lit(""))), cut)


def chunk_fixed(files: DataFrame, size: int = 50, overlap: int = 5) -> DataFrame:
    """A row for each line window of every file: path, start_line, end_line, content, chunk_type, breadcrumb."""
    keep = [c for c in files.columns if c != "content"]
    each = files.select(*keep, F.explode(window_texts(F.col("content"), size, overlap)).alias("_w"))
    start, end = F.col("_w.start"), F.col("_w.end")
    crumb = F.concat(F.col("path"), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return each.select(
        *keep, start.cast("long").alias("start_line"), end.cast("long").alias("end_line"), F.col("_w.text").alias("content"),
        F.lit("fixed_size").alias("chunk_type"), crumb.alias("breadcrumb"),
    )


def chunk_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """A row for each span (path, start_line, end_line, ...) with the file's lines in it."""
    lined = files.select("path", split_lines(F.col("content")).alias("_lines"))
    text = F.array_join(F.slice("_lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    return spans.join(lined, "path").withColumn("content", text).drop("_lines")


def source_lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no, line), 1-based."""
    lines = files.select("path", "language", F.posexplode(split_lines(F.col("content"))).alias("at", "line"))
    return lines.select("path", "language", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def extract_definitions(files: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(path, language, kind, name, start_line, end_line): declarations found by pattern.

    A definition ends before the next declaration of the same or a lower indent, or with the file; decorator lines
    directly above belong to it.
    """
    lines = source_lines(files)
    found = None
    for language, rule in (rules or DEFINITIONS).items():
        hit = lines.filter((F.col("language") == language) & F.col("line").rlike(rule)).select(
            "path", "language", "line_no", F.length(F.regexp_extract("line", rule, 1)).alias("indent"), F.regexp_extract("line", rule, 2).alias("kind"), F.regexp_extract("line", rule, 3).alias("name")
        )
        found = hit if found is None else found.unionByName(hit)
    totals = lines.groupBy("path").agg(F.max("line_no").alias("lines"))
    ends = _next_outside(found)
    marks = lines.filter(F.trim("line").startswith("@")).select("path", F.col("line_no").alias("mark"))
    run = marks.withColumn("island", F.col("mark") - F.row_number().over(Window.partitionBy("path").orderBy("mark")))
    islands = run.groupBy("path", "island").agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
    above = ends.join(islands.select("path", "first", (F.col("last") + 1).alias("line_no")), ["path", "line_no"], "left").join(totals, "path")
    kind = F.when(F.col("kind").isin(*CLASS_KINDS), "class").otherwise("function")
    return above.select("path", "language", kind.alias("kind"), "name", F.coalesce("first", "line_no").alias("start_line"), F.coalesce(F.col("next") - 1, F.col("lines")).alias("end_line"))


def _next_outside(found: DataFrame) -> DataFrame:
    """``found`` with ``next``: the line of the next declaration of its file of the same or a lower indent.

    A fold from the last declaration to the first over a stack of rising indents: what is indented deeper than the
    declaration at hand can end none above it.
    """
    place = F.struct("line_no", "indent", "language", "kind", "name")
    per_file = found.groupBy("path").agg(F.sort_array(F.collect_list(place), asc=False).alias("found"))
    stack = F.array().cast("array<struct<line_no:bigint,indent:int>>")
    start = F.struct(stack.alias("open"), F.array().cast("array<bigint>").alias("next"))

    def step(acc: Column, d: Column) -> Column:
        def at(still: Column) -> Column:
            own = F.array(F.struct(d["line_no"].alias("line_no"), d["indent"].alias("indent")))
            return F.struct(F.concat(own, still).alias("open"), F.concat(acc["next"], F.array(F.get(still, 0)["line_no"])).alias("next"))

        return bind(F.filter(acc["open"], lambda o: o["indent"] <= d["indent"]), at)

    folded = per_file.select("path", "found", F.aggregate("found", start, step)["next"].alias("next"))
    return folded.select("path", F.explode(F.arrays_zip("found", "next")).alias("d")).select("path", "d.found.*", "d.next")


def doc_comment_above(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """``declarations`` (path, start_line) with ``comment``: the run of // or # or * lines that ends on the line before."""
    lines = source_lines(files).withColumn("bare", F.trim("line"))
    notes = lines.filter(F.col("bare").rlike(r"^(//|#|/?\*)"))
    by = Window.partitionBy("path").orderBy("line_no")
    run = notes.withColumn("island", F.col("line_no") - F.row_number().over(by)).filter(~F.col("bare").startswith("//go:"))
    text = F.trim(F.regexp_replace("bare", r"^(//+|#+|/\*\*?|\*/|\*)\s?|\s*\*/$", ""))
    joined = run.groupBy("path", "island").agg(F.max("line_no").alias("last"), F.sort_array(F.collect_list(F.struct("line_no", text.alias("text")))).alias("rows"))
    said = joined.select("path", (F.col("last") + 1).alias("start_line"), F.array_join(F.filter(F.col("rows.text"), lambda t: t != ""), "\n").alias("comment"))
    return declarations.join(said, ["path", "start_line"], "left")


def ancestors(spans: DataFrame) -> DataFrame:
    """``spans`` (path, name, start_line, end_line) with ``ancestor_chain``: enclosing definitions, outermost first.

    A fold over a file's spans in order of their starts; it holds those that are still open.
    """
    place = F.struct("start_line", (-F.col("end_line")).alias("ne"), "name", "end_line")
    per_file = spans.groupBy("path").agg(F.sort_array(F.collect_list(place)).alias("spans"))
    opened = F.array().cast("array<struct<start_line:bigint,end_line:bigint,name:string>>")
    start = F.struct(opened.alias("open"), F.array().cast("array<array<string>>").alias("chains"))

    def step(acc: Column, d: Column) -> Column:
        def at(still: Column) -> Column:
            over = F.filter(still, lambda o: (o["end_line"] >= d["end_line"]) & ((o["start_line"] < d["start_line"]) | (o["end_line"] > d["end_line"])))
            own = F.array(F.struct(d["start_line"].alias("start_line"), d["end_line"].alias("end_line"), d["name"].alias("name")))
            chains = F.concat(acc["chains"], F.array(F.transform(over, lambda o: o["name"])))
            return F.struct(F.concat(still, own).alias("open"), chains.alias("chains"))

        return bind(F.filter(acc["open"], lambda o: o["end_line"] >= d["start_line"]), at)

    folded = per_file.select("path", "spans", F.aggregate("spans", start, step)["chains"].alias("chains"))
    each = folded.select("path", F.explode(F.arrays_zip("spans", "chains")).alias("d"))
    return each.select("path", "d.spans.name", "d.spans.start_line", "d.spans.end_line", F.col("d.chains").alias("ancestor_chain"))


def fallback_chunks(files: DataFrame, definition_chunks: DataFrame, size: int = 50, overlap: int = 5) -> DataFrame:
    """Definition chunks, and line windows of the files that have none."""
    rest = files.join(definition_chunks.select("path").distinct(), "path", "left_anti")
    return definition_chunks.select("path", "start_line", "end_line", "content", "chunk_type").unionByName(chunk_fixed(rest, size, overlap).select("path", "start_line", "end_line", "content", "chunk_type"))


def file_summaries(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, content, end_line): purpose, counts and the first ten top-level names of each file, at most 1000 chars.

    ``files``: path, name, lines, docstring; ``definitions``: path, kind, name, start_line, depth.
    """
    top = F.when((F.col("depth") == 0) & (F.col("def_name") != ""), F.struct("start_line", "def_name"))
    d = definitions.withColumnRenamed("name", "def_name")
    counted = d.groupBy("path").agg(F.count_if(F.col("kind") == "function").alias("nf"), F.count_if(F.col("kind") == "class").alias("nc"), F.transform(F.sort_array(F.collect_list(top)), lambda t: t["def_name"]).alias("exports"))
    j = files.join(counted, "path", "left").withColumn("nf", F.coalesce("nf", F.lit(0))).withColumn("nc", F.coalesce("nc", F.lit(0))).withColumn("exports", F.coalesce("exports", F.array().cast("array<string>")))
    n = F.size("exports")
    more = F.when(n > 10, F.concat(F.lit("  ("), (n - 10).cast("string"), F.lit(" more)")))
    named = F.when(n > 0, F.concat_ws("\n", F.concat(F.lit("Main exports: "), F.array_join(F.slice("exports", 1, 10), ", ")), more, F.lit("")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("File: "), "path"), F.concat(F.lit("Purpose: "), infer_file_purpose(F.col("name"), F.col("nf"), F.col("nc"))), F.lit(""), F.lit("Components:"),
        F.concat(F.lit("- "), F.col("nf").cast("string"), F.lit(" functions")), F.concat(F.lit("- "), F.col("nc").cast("string"), F.lit(" classes")), F.lit(""), named, F.col("docstring"),
    )
    return j.select("path", cut(text).alias("content"), F.greatest("lines", F.lit(1)).cast("long").alias("end_line"))


def cut(text: Column, most: int = 1000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def class_summaries(classes: DataFrame, methods: DataFrame, more_methods: int = 5, more_lines: int = 100) -> DataFrame:
    """(path, class_name, content) of classes with over five methods or a hundred lines.

    ``classes``: path, class_name, docstring, start_line, end_line; ``methods``: path, class_name, name, docstring, start_line.
    """
    private = F.col("m.name").startswith("_") & ~F.col("m.name").startswith("__")
    doc = F.when(F.length("m.docstring") > 60, F.concat(F.substring("m.docstring", 1, 57), F.lit("..."))).otherwise(F.col("m.docstring"))
    line = F.when(F.length("m.docstring") > 0, F.concat(F.lit("- "), "m.name", F.lit(": "), doc)).otherwise(F.concat(F.lit("- "), "m.name"))
    public = F.when((F.col("m.name") != "") & ~private, F.struct("m.start_line", line.alias("line")))
    met = classes.alias("c").join(methods.alias("m"), (F.col("c.path") == F.col("m.path")) & (F.col("c.class_name") == F.col("m.class_name")), "left")
    g = met.groupBy("c.path", "c.class_name", "c.docstring", "c.start_line", "c.end_line").agg(
        F.count("m.name").alias("n"), F.count_if((F.col("m.name") != "") & private).alias("hidden"), F.transform(F.sort_array(F.collect_list(public)), lambda t: t["line"]).alias("lines")
    )
    large = g.filter((F.col("n") > more_methods) | (F.col("end_line") - F.col("start_line") + 1 > more_lines))
    shown = F.size("lines")
    says = F.when(F.length("docstring") > 0, F.col("docstring")).otherwise(infer_class_purpose(F.col("class_name")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Class: "), "class_name"), F.concat(F.lit("Purpose: "), says), F.lit(""), F.lit("Key methods:"), F.when(shown > 0, F.array_join(F.slice("lines", 1, 5), "\n")),
        F.when(shown > 5, F.concat(F.lit("- "), (shown - 5).cast("string"), F.lit(" more public methods"))), F.lit(""),
        F.concat(F.lit("Total: "), shown.cast("string"), F.lit(" public, "), F.col("hidden").cast("string"), F.lit(" private methods")),
    )
    return large.select("path", "class_name", cut(text).alias("content"))


def assemble_chunks(definitions: DataFrame, file_summary: DataFrame, class_summary: DataFrame) -> DataFrame:
    """All chunks of a file with ``place``: definitions by line, then the file's summary, then its classes'."""
    cols = ["path", "start_line", "chunk_type", "content"]
    every = definitions.select(*cols, F.lit(0).alias("part")).unionByName(file_summary.select(*cols, F.lit(1).alias("part"))).unionByName(class_summary.select(*cols, F.lit(2).alias("part")))
    order = Window.partitionBy("path").orderBy("part", "start_line", "content")
    return every.withColumn("place", F.row_number().over(order).cast("long")).drop("part")


def parse_guard(parsed: DataFrame, most_errors: float = 0.5) -> DataFrame:
    """(repository, files, errors, refusal) of (repository, failed, chunks): why a repository's chunks must not be replaced."""
    g = parsed.groupBy("repository").agg(F.count(F.lit(1)).alias("files"), F.count_if("failed").alias("errors"), F.sum(F.when(F.col("failed"), 0).otherwise(F.col("chunks"))).alias("chunks"))
    why = F.when(F.col("errors") == F.col("files"), "every file failed").when((F.col("errors") > 0) & (F.col("chunks") == 0), "no chunks").when(F.col("errors") > most_errors * F.col("files"), "most files failed")
    return g.select("repository", "files", "errors", why.alias("refusal"))


#: The most an archive may hold once expanded, a file's most bytes, and the most files and chunks of a repository.
CAPS = {"expanded_bytes": 500_000_000, "file_bytes": 1_000_000, "files": 20_000, "chunks": 100_000}


def skip_counts(files: DataFrame) -> DataFrame:
    """(repository, reason, files): how many files of (repository, reason) are left out for each reason; no paths."""
    return files.filter(F.col("reason") != "indexable").groupBy("repository", "reason").agg(F.count(F.lit(1)).alias("files"))


def apply_caps(files: DataFrame, chunks: DataFrame | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """(repository, refusal): the first cap that a repository exceeds, null for none.

    ``files``: repository, bytes; ``chunks``: repository. ``caps`` overrides some of CAPS.
    """
    most = CAPS | (caps or {})
    g = files.groupBy("repository").agg(F.sum("bytes").alias("expanded_bytes"), F.max("bytes").alias("file_bytes"), F.count(F.lit(1)).alias("files"))
    if chunks is not None:
        g = g.join(chunks.groupBy("repository").agg(F.count(F.lit(1)).alias("chunks")), "repository", "left")
    over = [F.when(F.col(c) > most[c], F.lit(c)) for c in CAPS if c in g.columns]
    return g.select("repository", F.coalesce(*over).alias("refusal"))


def distinct_content(chunks: DataFrame) -> DataFrame:
    """The first chunk (by path, start_line) of each content hash."""
    order = Window.partitionBy("content_hash").orderBy("path", "start_line")
    return chunks.withColumn("content_hash", content_hash(F.col("content"))).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def hash_embedding(texts: list[str], dims: int = 64) -> list[list[float]]:
    """A deterministic provider: signed word hashes folded into ``dims``, of unit length."""
    import math
    import zlib

    out = []
    for text in texts:
        v = [0.0] * dims
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dims] += 1.0 if h >> 31 else -1.0
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / size for x in v])
    return out


def embed_batches(texts: DataFrame, known: DataFrame, provider: Callable[[list[str]], list[list[float]]] = hash_embedding, model: str = "hash-64", batch: int = 100) -> DataFrame:
    """(content_hash, embedding, embedding_model) of (content_hash, text) that ``known`` (content_hash, embedding_model) doesn't have of this model. Blank texts embed as ``[empty]``."""
    fresh = texts.join(known.filter(F.col("embedding_model") == model).select("content_hash"), "content_hash", "left_anti")

    def embed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                yield pd.DataFrame({"content_hash": some["content_hash"], "embedding": provider([t if t and t.strip() else "[empty]" for t in some["text"]]), "embedding_model": model})

    return fresh.select("content_hash", "text").repartition("content_hash").mapInPandas(embed, "content_hash string, embedding array<double>, embedding_model string")


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with their content's vector, and the chunks without one, which must be none before a write."""
    return chunks.join(vectors, "content_hash"), chunks.join(vectors, "content_hash", "left_anti")


def ingest_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per repository: files, errors, chunks, distinct contents, truncated chunks. Repositories without chunks stay."""
    f = files.groupBy("repository").agg(F.count(F.lit(1)).alias("files"), F.count_if("failed").alias("errors"))
    c = chunks.groupBy("repository").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("content_hash").alias("embedded"), F.count_if("truncated").alias("truncated"))
    return f.join(c, "repository", "left").na.fill(0, ["chunks", "embedded", "truncated"])


class ChunkFixedUdtf:
    """``SELECT * FROM chunk_fixed(content, size, overlap)``: a text's line windows, for SQL."""

    def eval(self, content: str, size: int, overlap: int):
        lines = (content or "").splitlines()
        if not lines:
            yield 1, 1, ""
        at = 0
        while at < len(lines):
            end = min(at + size, len(lines))
            if end < len(lines):
                blank = [i for i in range(max(at + 1, end - REACH), min(len(lines), end + REACH)) if not lines[i].strip()]
                end = min(blank, key=lambda i: (abs(i - end), i)) + 1 if blank else end
            yield at + 1, end, "\n".join(lines[at:end])
            if end >= len(lines):
                return
            at = max(end - overlap, at + 1)


def register_udtf(spark) -> None:
    """Make ``chunk_fixed`` callable from SQL."""
    spark.udtf.register("chunk_fixed", F.udtf(ChunkFixedUdtf, returnType="start_line int, end_line int, content string"))
