"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards of documents.

A shard holds the postings of some documents, a list per term, in varint blocks of BLOCK postings with the last document
and the highest contribution of each block. For a query, lists are taken in falling order of their bounds. While the
bounds of the remaining lists together reach the threshold, lists are essential and are read whole: each of their
documents is a candidate. After that, a candidate goes as soon as its score so far, the maximum of its block in the
next list and the bounds of the lists after that stay below the threshold; only blocks that still have a candidate are decoded.
The threshold starts at the best single-term kth contribution of any shard, so shards don't start from nothing.
Each shard's heap is merged into the query's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tessarine.llm._text import Cut, slices
from tessarine.llm._work import materialize
from tessarine.operators.retrieval import counted_small

#: Fixed values of the ranking: whatever is no ASCII letter, digit or non-ASCII character parts terms.
BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SATURATION, LENGTH_SHARE = 20, 50

BLOCK = 128
SHARD_BYTES, SHARD_DOCS, SLICE_BYTES = 16 << 20, 1 << 16, 4 << 20
PACK_ITEMS = 64
"""Queries that meet a shard in one group, on average."""

_ROWS = "shard long, term string, size int, top int, kth int, lasts binary, tops binary, ends binary, postings binary"
_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("size", pa.int32()), ("top", pa.int32()), ("kth", pa.int32()), ("lasts", pa.binary()), ("tops", pa.binary()), ("ends", pa.binary()), ("postings", pa.binary())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it, -, -) and (null, -, documents with a term, all terms) of each slice."""
    for batch in batches:
        for some in slices(batch, "text", SLICE_BYTES):
            cut = Cut(some.column("text"), BREAKS)
            pairs = np.unique(cut.place.astype(np.int64) << 32 | cut.row)
            df = np.bincount(pairs >> 32, minlength=len(cut.known))
            nothing = np.zeros(len(df) + 1, np.int64)
            n, length = nothing.copy(), nothing.copy()
            n[-1], length[-1] = len(np.unique(cut.row)), len(cut.row)
            terms = pa.concat_arrays([cut.known.cast(pa.large_string()).cast(pa.string()), pa.array([None], pa.string())])
            yield pa.RecordBatch.from_pydict({"term": terms, "df": pa.array(np.append(df, 0)), "n": pa.array(n), "length": pa.array(length)})


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Varints of whole numbers from 0 in a row, seven bits to a byte, and where each ends."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1 << 7 * j)).astype(np.int64) for j in range(1, 9))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(int(size.max(initial=0))):
        here = size > j
        more = (size[here] > j + 1).astype(np.uint8) << 7
        out[(ends - size)[here] + j] = ((v[here] >> np.uint64(7 * j)) & np.uint64(127)).astype(np.uint8) | more
    return out, ends


def decode(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.empty(0, np.int64)
    at = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * at, first) if len(first) else np.empty(0, np.int64)


def _flat(values: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    """A binary for each list, of ``counts`` values of ``width`` bytes."""
    offsets = np.concatenate([[0], np.cumsum(counts) * width])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def shard_rows(shard: int, ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """The shard's head (no term; postings: document ids; tops: their length norms; lasts: which ids are null) and its lists, ordered by term."""
    given, missing = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((given, missing))
    given, missing = given[order], missing[order]
    cut = Cut(texts.take(pa.array(order)), BREAKS)
    lengths = np.bincount(cut.row, minlength=len(given)).astype(np.int64)
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n_docs) // max(1, n_terms)
    yield pa.RecordBatch.from_pylist([{"shard": shard, "size": len(given), "postings": given.astype("<i8").tobytes(), "tops": m.astype("<i8").tobytes(), "lasts": missing.astype(np.uint8).tobytes()}], _SCHEMA)
    if not len(cut.place):
        return
    by_term = cut.known.to_pylist()
    sort = np.array(sorted(range(len(by_term)), key=by_term.__getitem__))
    rank = np.empty(len(sort), np.int64)
    rank[sort] = np.arange(len(sort))
    pairs, tf = np.unique(rank[cut.place] << 32 | cut.row, return_counts=True)
    term, doc = pairs >> 32, pairs & 0xFFFFFFFF
    c = contribution(tf, m[doc])
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    sizes = np.diff(np.append(first, len(term)))
    gaps = np.diff(doc, prepend=-1)
    gaps[first] = doc[first] + 1
    values = np.empty(2 * len(doc), np.int64)
    values[0::2], values[1::2] = gaps, tf
    raw, ends = encode(values)
    blocks = -(-sizes // BLOCK)
    of_list = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(of_list)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[of_list] + nth * BLOCK
    stop = np.minimum(begin + BLOCK, (first + sizes)[of_list])
    byte_at = np.concatenate([[0], ends])[2 * np.append(first, len(doc))]
    kth = np.zeros(len(sizes), np.int64)
    for i in np.flatnonzero(sizes >= k):
        kth[i] = np.partition(c[first[i] : first[i] + sizes[i]], sizes[i] - k)[sizes[i] - k]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(sizes), shard)), pa.array([by_term[i].decode() for i in sort], pa.string()), pa.array(sizes.astype(np.int32)), pa.array(np.maximum.reduceat(c, first).astype(np.int32)), pa.array(kth.astype(np.int32)),
            _flat(doc[stop - 1].astype("<i4"), blocks, 4), _flat(np.maximum.reduceat(c, begin).astype("<i4"), blocks, 4), _flat((ends[2 * stop - 1] - byte_at[:-1][of_list]).astype("<i4"), blocks, 4), _flat(raw, np.diff(byte_at), 1),
        ],
        schema=_SCHEMA,
    )


def _shards(n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, waiting, size, rows = TaskContext.get().partitionId() << 32, 0, [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            yield from shard_rows(base + made, whole.column("doc_id").combine_chunks(), whole.column("text").combine_chunks(), n_docs, n_terms, k)

        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                for at in range(0, len(some), SHARD_DOCS):
                    part = some.slice(at, SHARD_DOCS)
                    bytes_here = part.column("text").nbytes
                    if waiting and (size + bytes_here > SHARD_BYTES or rows + len(part) > SHARD_DOCS):
                        yield from out()
                        made, waiting, size, rows = made + 1, [], 0, 0
                    waiting.append(part)
                    size, rows = size + bytes_here, rows + len(part)
        if waiting:
            yield from out()

    return run


def build_index(docs: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame, int]:
    """(index, (term, df), documents with a term): shards of at most SHARD_DOCS documents and SHARD_BYTES of text (or one longer text), made where the documents are read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counts, "term string, df long, n long, length long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "n", "length")))
    stats = materialize(counted, "terms")
    whole = stats.filter("term IS NULL").first()
    n, length = (whole["n"], whole["length"]) if whole else (0, 0)
    return materialize(rows.mapInArrow(_shards(n, length, k), _ROWS), "index"), stats.filter("term IS NOT NULL").select("term", "df"), n


class Postings:
    """A term's list in one shard."""

    def __init__(self, row: dict, m: np.ndarray) -> None:
        self.top, self.m, self.read = row["top"], m, 0
        self.lasts, self.tops, ends = (np.frombuffer(row[x], "<i4").astype(np.int64) for x in ("lasts", "tops", "ends"))
        self.raw, self.starts, self.ends = np.frombuffer(row["postings"], np.uint8), np.concatenate([[0], ends[:-1]]), ends
        self.sizes = np.full(len(ends), BLOCK)
        self.sizes[-1] = row["size"] - BLOCK * (len(ends) - 1)
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            self.whole = self.blocks(np.arange(len(self.ends)))
        return self.whole

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, contributions) of some blocks in order."""
        self.read += len(which)
        raw = self.raw if len(which) == len(self.ends) else np.concatenate([self.raw[a:b] for a, b in zip(self.starts[which], self.ends[which], strict=True)])
        gaps, tf = decode(raw).reshape(-1, 2).T
        upto, sizes = np.cumsum(gaps), self.sizes[which]
        first = np.cumsum(sizes) - sizes
        base = np.where(which > 0, self.lasts[which - 1], -1) - (upto[first] - gaps[first])
        docs = upto + np.repeat(base, sizes)
        return docs, contribution(tf, self.m[docs])


def best(lists: list[tuple[int, Postings]], n_docs: int, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that may be among a query's k best: those of at least ``floor`` and of the kth best here, by score, then document."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0] * x[1].top)
    upto = np.cumsum([w * p.top for w, p in lists]).tolist()
    score, least = np.zeros(n_docs, np.int64), max(1, floor)
    i = len(lists) - 1

    def raised(at: np.ndarray) -> int:
        return max(least, int(np.partition(at, len(at) - k)[len(at) - k])) if len(at) >= k else least

    while i >= 0 and upto[i] >= least:
        w, own = lists[i]
        docs, c = own.all()
        score[docs] += w * c
        least = raised(score)
        i -= 1
    alive = np.flatnonzero(score)
    while i >= 0 and len(alive):
        w, own = lists[i]
        alive = alive[score[alive] + upto[i] >= least]
        b = np.searchsorted(own.lasts, alive)
        most = np.where(b < len(own.lasts), w * own.tops[np.minimum(b, len(own.lasts) - 1)], 0)
        fine = score[alive] + most + (upto[i - 1] if i else 0) >= least
        alive, b = alive[fine], b[fine]
        need = np.unique(b[b < len(own.lasts)])
        if len(need):
            docs, c = own.whole if own.whole is not None else own.blocks(need)
            at = np.searchsorted(docs, alive)
            hit = docs[np.minimum(at, len(docs) - 1)] == alive
            score[alive[hit]] += w * c[at[hit]]
            least = raised(score[alive])
        i -= 1
    alive = alive[score[alive] >= least]
    order = np.lexsort((alive, -score[alive]))[:k]
    return alive[order], score[alive[order]]


def _search(k: int, item_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "item_id": [], "doc_id": [], "score": []}
        rows = table.to_pylist()
        head = next(r for r in rows if r["term"] is None)
        ids, m, missing = np.frombuffer(head["postings"], "<i8"), np.frombuffer(head["tops"], "<i8"), np.frombuffer(head["lasts"], np.uint8)
        asked: dict = {}
        for r in rows:
            if r["term"] is not None:
                own = Postings(r, m)
                for q in r["asked"]:
                    asked.setdefault(q["query"], (q["item_id"], q["floor"], []))[2].append((q["w"], own))
        for q, (item, floor, lists) in asked.items():
            docs, scores = best(lists, len(ids), floor, k)
            out["query"] += [q] * len(docs)
            out["item_id"] += [item] * len(docs)
            out["doc_id"] += [None if missing[d] else int(ids[d]) for d in docs]
            out["score"] += scores.tolist()
        return pa.table({"query": pa.array(out["query"], pa.string()), "item_id": pa.array(out["item_id"], item_type), "doc_id": pa.array(out["doc_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return run


def search_index(index: DataFrame, terms: DataFrame, n_docs: int, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of an index that was built for at least this k.

    Only lists of asked terms are read. A list goes to each pack of queries that ask for it, with these queries beside it; queries themselves are not copied to shards.
    """
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    each = items.select("item_id", text.alias("text")).distinct().select("item_id", F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.sha2("text", 256)).alias("query"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(1)))).alias("term"))
    packs = 1 + items.count() // PACK_ITEMS
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    asked = materialize(terms.join(counted_small(each), "term").select("query", "item_id", "term", weight.alias("w"), F.pmod(F.xxhash64("query"), F.lit(packs)).alias("pack")).filter("w > 0"), "asked")
    kth = index.filter("kth > 0").join(counted_small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.max("kth").cast("long").alias("kth"))
    floors = asked.join(kth, "term", "left").groupBy("query").agg(F.coalesce(F.max(F.col("w") * F.col("kth")), F.lit(0)).cast("long").alias("floor"))
    by_term = asked.join(floors, "query").groupBy("term", "pack").agg(F.collect_list(F.struct("query", "item_id", "w", "floor")).alias("asked"))
    lists = index.join(counted_small(by_term), "term")
    heads = index.filter("term IS NULL").withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long")))).withColumn("asked", F.lit(None).cast(by_term.schema["asked"].dataType))
    item = items.schema["item_id"].dataType
    found = lists.unionByName(heads).groupBy("shard", "pack").applyInArrow(_search(k, to_arrow_type(item)), f"query string, item_id {item.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents by score, ties by doc_id, without documents of score 0.

    Null texts have no terms. Rows that share an id, or have none, are documents of their own; null ids come last among
    equal scores. Items of equal id and text (but for A-Z) are one item; of an id with several texts each is answered with
    ranks of its own. Items without a known term have no rows; no documents give none. Other columns play no part.
    """
    index, terms, n = build_index(docs, k)
    return search_index(index, terms, n, items, k)
