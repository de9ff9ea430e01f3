"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors are cut into blocks of consecutive documents. A block keeps a forward index (its vectors) and, for each term
(dimension), its greatest and least weight. For a query, the block's summed term maxima bound every score in it.
Blocks are scored in the order of their bounds until a bound falls below the query's kth best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessarine.llm._work import materialize

BLOCK = 256
SHARD_ROWS = 8192
QUERY_ROWS = 4096
EXACT = 2.0**53

_BLOCKS = "shard long, rows binary, vec_ids binary, weights binary, width int"
_PACKED = pa.schema([("shard", pa.int64()), ("rows", pa.binary()), ("vec_ids", pa.binary()), ("weights", pa.binary()), ("width", pa.int32())])


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, terms): ``floor(scale * x)`` of rows whose vectors are whole: no nulls, all finite, id present."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("terms"))


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = [np.asarray(x, np.int64) for x in lists.to_pylist()]
    out = np.zeros((len(rows), max([0, *map(len, rows)])), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _pack(shard: int, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> dict:
    return {"shard": shard, "rows": rows.astype("<i8").tobytes(), "vec_ids": ids.astype("<i8").tobytes(), "weights": matrix.astype("<i8").tobytes(), "width": matrix.shape[1]}


def _packed(rows_each: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
            for at in range(0, len(batch), rows_each):
                some = [_pack(batch.column("shard")[at].as_py(), rows[at : at + rows_each], ids[at : at + rows_each], _matrix(batch.column("terms").slice(at, rows_each)))]
                yield pa.RecordBatch.from_pylist(some, _PACKED)

    return pack


def _blocks(packed: pd.DataFrame, width: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    rows, ids = ([np.frombuffer(x, "<i8") for x in packed[c]] for c in ("rows", "vec_ids"))
    weights = []
    for raw, n, at in zip(packed["weights"], map(len, ids), packed["width"], strict=True):
        full = np.zeros((n, width), np.int64)
        full[:, :at] = np.frombuffer(raw, "<i8").reshape(n, at)
        weights.append(full)
    return rows, ids, weights


def search(queries: tuple[np.ndarray, np.ndarray], rows: list[np.ndarray], ids: list[np.ndarray], weights: list[np.ndarray], k: int) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
    """(query row, its k best (score, vec_id) of other rows, blocks scored). Ties go to the smaller vec_id, so a bound equal to the kth score is still scored."""
    of, terms = queries
    most = max([1, *(int(np.abs(w).max(initial=0)) for w in weights)]) * max(1, int(np.abs(terms).max(initial=0))) * max(1, terms.shape[1])
    kind = np.float64 if most < EXACT else object if most >= 2**62 else np.int64
    terms, weights = terms.astype(kind), [w.astype(kind) for w in weights]
    high = np.stack([w.max(axis=0) for w in weights])
    low = np.stack([w.min(axis=0) for w in weights])
    zero = terms * 0
    bounds = np.maximum(terms, zero) @ high.T + np.minimum(terms, zero) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    for q in range(len(of)):
        best_s, best_i = np.empty(0, kind), np.empty(0, np.int64)
        scored = 0
        for b in order[q]:
            if len(best_s) >= k and bounds[q, b] < best_s[k - 1]:
                break
            scored += 1
            s = np.concatenate([best_s, weights[b] @ terms[q]])
            i = np.concatenate([best_i, ids[b]])
            fine = np.arange(len(i)) < len(best_i)
            fine[len(best_i) :] = rows[b] != of[q]
            if len(best_s) >= k:
                fine &= s >= best_s[k - 1]
            s, i = s[fine], i[fine]
            top = np.lexsort((i, -s))[:k] if kind is not object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k], int)
            best_s, best_i = s[top], i[top]
        yield int(of[q]), [(int(a), int(b)) for a, b in zip(best_s, best_i, strict=True)], scored


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query row (vec_id divisible by ``every``), itself excluded.

    Vectors that are null or hold a null or non-finite component take no part, nor do null ids. Vectors of other
    lengths count as ending in zeros. Rows that share an id are separate candidates and separate queries: each has ranks
    of its own, and the others of its id among its candidates. Scores are exact integers. Queries meet rows in a grid of packed shards: one task
    holds SHARD_ROWS rows and QUERY_ROWS queries, whatever the table's size. No rows give no rows.
    """
    terms = materialize(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "terms")
    n = terms.count()
    shards, packs = max(1, -(-n // SHARD_ROWS)), max(1, -(-n // (every * QUERY_ROWS)))
    ranged = terms.repartitionByRange(max(shards, 1), "vec_id").sortWithinPartitions("vec_id").withColumn("shard", F.spark_partition_id().cast("long"))
    rows = materialize(ranged.mapInArrow(_packed(BLOCK), _BLOCKS), "blocks")
    shards = (rows.agg(F.max("shard")).first()[0] or 0) + 1
    asked = terms.filter(F.col("vec_id") % every == 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(packs)))
    asked = materialize(asked.repartition(packs, "shard").sortWithinPartitions("shard").groupBy("shard").applyInArrow(_pack_group, _BLOCKS), "queries")
    of_rows = rows.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).withColumn("pack", F.col("pack").cast("long"))
    of_asked = asked.withColumnRenamed("shard", "pack").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            width = int(max(left["width"].max(), right["width"].max()))
            held = _blocks(left, width)
            for of, names, terms_ in zip(*_blocks(right, width), strict=True):
                name = dict(zip(of.tolist(), names.tolist(), strict=True))
                found += [(q, name[q], i, s) for q, best, _ in search((of, terms_), *held, k) for s, i in best]
        return pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    met = of_rows.groupBy("shard", "pack").cogroup(of_asked.groupBy("shard", "pack")).applyInPandas(meet, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack_group(table: pa.Table) -> pa.Table:
    ids, rows = (table.column(c).to_numpy() for c in ("vec_id", "row"))
    some = [_pack(table.column("shard")[at].as_py(), rows[at : at + BLOCK], ids[at : at + BLOCK], _matrix(table.column("terms").slice(at, BLOCK))) for at in range(0, len(table), BLOCK)]
    return pa.Table.from_pylist(some, _PACKED)
