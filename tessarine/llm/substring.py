"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash over the last 16 bytes decides at each word end whether a chunk ends there, so chunk borders depend on the
words around them alone: text inserted before a passage doesn't shift its chunks. Windows of neighbouring chunks that
hold just MIN_WORDS words or more are known by their digest, and each digest belongs to the document with the smallest
id that has it. Windows that belong to other documents, or stood in the same one before, are removed: all that goes
stood together elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm._text import mix
from tessarine.llm._work import join_counted, materialize

MEAN_WORDS = 4
MAX_WORDS = 64
MIN_WORDS = 20

_GEAR = np.random.default_rng(4_099).integers(0, 2**16, 256, dtype=np.uint16)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LAST = 2**63 - 1
_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2h + GEAR[byte] (mod 2^16) at every byte, by doubling the window four times."""
    h = _GEAR[raw]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
    return h


def chunks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive byte places) of the chunks of a text and the words in each; none for an empty text."""
    if not raw:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    last_of_gap = np.flatnonzero(blank[:-1] & ~blank[1:])
    first_of_gap = np.flatnonzero(~blank[:-1] & blank[1:])
    h = gear(data)
    if len(last_of_gap) and blank[0]:
        inner = last_of_gap[1:]
    else:
        inner = last_of_gap
    ends_word = first_of_gap[: len(inner)]
    chosen = np.flatnonzero(h[ends_word] < 2**16 // MEAN_WORDS) + 1
    total = len(inner) + 1 if not blank.all() else 0
    marks = np.concatenate([[0], chosen, [total]])
    wide = np.flatnonzero(np.diff(marks) > MAX_WORDS)
    if len(wide):
        extra = [np.arange(marks[i] + MAX_WORDS, marks[i + 1], MAX_WORDS) for i in wide]
        marks = np.unique(np.concatenate([marks, *extra]))
    marks = marks[1:] if total else np.array([0])
    ends = np.append(inner[marks[:-1] - 1] + 1, len(raw)) if total else np.array([len(raw)])
    return ends.astype(np.int64), np.diff(np.concatenate([[0], marks])).astype(np.int64)


def _digests(raw: bytes, ends: np.ndarray) -> list[int]:
    at, out = 0, []
    for end in ends.tolist():
        out.append(xxhash.xxh3_64_intdigest(raw[at:end].rstrip()) - 2**63)
        at = end
    return out


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends of chunks, first chunk, end chunk, digest) of a text's windows, by first chunk.

    From each chunk the shortest run of at least MIN_WORDS words that starts with it, and to each the shortest that ends
    with it: together those within a copied run of MIN_WORDS words cover all its chunks.
    """
    ends, words = chunks(raw)
    n = len(ends)
    upto = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n + 1)
    to, since = np.searchsorted(upto, upto + MIN_WORDS), np.searchsorted(upto, upto - MIN_WORDS, "right") - 1
    spans = np.unique(np.concatenate([(at * (n + 1) + to)[to <= n], (since * (n + 1) + at)[since >= 0]]))
    first, last = np.divmod(spans, n + 1)
    if not len(spans):
        return ends, first, last, np.empty(0, np.int64)
    own = mix(np.array(_digests(raw, ends), np.int64).view(np.uint64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[:-1], dtype=np.uint64)])
    return ends, first, last, mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)).view(np.int64)


def _raw(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "replace")


def _list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1024):
            some = batch.slice(at, 1024)
            found, counts = [], []
            for text in some.column("text"):
                raw = _raw(text)
                own = np.unique(windows(raw)[3])
                found.append(own)
                counts.append(len(own))
            ids, parts = (np.repeat(some.column(c).to_numpy(zero_copy_only=False), counts) for c in ("id", "part"))
            yield pa.record_batch([pa.array(np.concatenate(found)), pa.array(ids, pa.int64()), pa.array(parts, pa.int32())], ["digest", "id", "part"])


def repeated_runs(ends: np.ndarray, first: np.ndarray, last: np.ndarray, digests: list[int], others: dict[int, int]) -> tuple[list[tuple[int, int]], set[int]]:
    """(start byte, end byte) of the runs to remove, and the owners of their windows."""
    seen, runs, owners = set(), [], set()
    for a, b, d in zip(first.tolist(), last.tolist(), digests, strict=True):
        if d in others or d in seen:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
            if d in others:
                owners.add(others[d])
        seen.add(d)
    return [(int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b in runs], owners


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1024):
            some = batch.slice(at, 1024)
            texts, spans, owners = [], [], []
            for text, copied in zip(some.column("text"), some.column("copied").to_pylist(), strict=True):
                raw = _raw(text)
                ends, first, end_, digests = windows(raw)
                runs, own = repeated_runs(ends, first, end_, digests.tolist(), {c["digest"]: c["owner"] for c in copied or ()})
                if not runs:
                    texts.append(text.as_py())
                    spans.append([])
                    owners.append([])
                    continue
                kept, last, places, char = [], 0, [], 0
                for start, end in runs:
                    char += len(raw[last:start].decode())
                    wide = len(raw[start:end].decode())
                    places.append({"start": char, "end": char + wide})
                    char += wide
                    kept.append(raw[last:start])
                    last = end
                kept.append(raw[last:])
                texts.append(b"".join(kept).decode())
                spans.append(places)
                owners.append(sorted(own))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = {"text": pa.array(texts, pa.string()), "spans": pa.array(spans, kind), "copied_from": pa.array(owners, pa.list_(pa.int64()))}
            yield pa.record_batch([*(some.column(c) for c in some.schema.names if c not in ("text", "copied")), *out.values()], [*(c for c in some.schema.names if c not in ("text", "copied")), *out])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``, and two columns: ``spans``, ``copied_from``.

    ``spans`` holds the removed [start, end) places in code points of the whole text, ``copied_from`` the doc_ids that
    keep those passages. Rows that share a doc_id are one owner and keep each other's passages. A null doc_id owns
    only what no other document has. A null text stays null; an empty one stays empty; a text that is a copy throughout
    becomes empty, and its row stays. Other columns pass unchanged, also ones called spans or copied_from, which are
    then found under their own names in a struct ``row``. No rows give no rows.
    """
    names = docs.columns
    # rows of one id are told apart by their texts, so that however many they are, no list holds more than one text's windows
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.hash("text").alias("part")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).dropFields("text").alias("row") if len(names) > 1 else F.lit(0).alias("row"), "text", *key)
    listed = docs.select("text", *key).mapInArrow(_list_windows, "digest long, id long, part int")
    stat = listed.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    shared = materialize(stat.filter("owner < last").drop("last"), "shared")
    total = shared.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    copies = join_counted(listed, shared, "digest", total).filter("id <> owner")
    copied = materialize(copies.groupBy("id", "part").agg(F.collect_set(F.struct("digest", "owner")).alias("copied")), "copies")
    joined = whole.join(copied, ["id", "part"], "left").select("row", "text", "copied")
    kind = dict(zip(joined.columns, (f.dataType.simpleString() for f in joined.schema), strict=True))
    return joined.mapInArrow(_remove, f"row {kind['row']}, text string, spans array<struct<start:bigint,end:bigint>>, copied_from array<bigint>")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``; all rows and columns stay."""
    done = remove_repeats(docs)
    return done.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
