"""Cosine scores over packed blocks: vectors of a scope lie in matrices, and a block of queries meets each by one product.

A table of vectors is packed where it is read, so packing shuffles nothing. Blocks meet the queries of their scope in
groups of bounded bytes; each group keeps a bounded heap per query, and only heaps are shuffled and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tessarine.shared import materialize

BLOCK_BYTES = 1 << 20
"""Bytes of a block's matrix, or one vector."""
GROUP_BYTES = 64 << 20
"""About so many bytes of blocks meet so many bytes of queries in one task."""
BUFFER_BYTES = 32 << 20
HOT_SCOPES = 1000
ROUNDED = 1e6


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _packer(scope: list[str], id_type: pa.DataType):
    names = [*scope, "dim", "ids", "matrix"]

    def blocks(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting).append_column("dim", pa.chunked_array([b.column("embedding").value_lengths().cast(pa.int32()) for b in waiting]))
        keys = [*scope, "dim"]
        table = table.sort_by([(k, "ascending") for k in keys]).combine_chunks()
        new = np.zeros(len(table), bool)
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        new[:1] = True
        starts = np.append(np.flatnonzero(new), len(table))
        lists, ids = table.column("embedding").combine_chunks(), table.column("id").combine_chunks()
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            dim = int(table.column("dim")[a].as_py())
            rows = max(1, BLOCK_BYTES // (8 * max(1, dim)))
            for at in range(a, b, rows):
                n = min(rows, b - at)
                flat = lists.slice(at, n).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                matrix = _unit(flat.reshape(n, dim))
                yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().slice(at, 1) for k in scope), pa.array([dim], pa.int32()), pa.array([ids.slice(at, n).to_pylist()], pa.list_(id_type)), pa.array([matrix.astype("<f8").tobytes()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= BUFFER_BYTES:
                yield from blocks(waiting)
                waiting, size = [], 0
        if size or any(len(b) for b in waiting):
            yield from blocks([b for b in waiting if len(b)])

    return run


def pack_vectors(vectors: DataFrame, scope: list[str], key: str, label: str = "vectors") -> DataFrame:
    """(scope columns, dim, ids, matrix): blocks of at most BLOCK_BYTES of normalised vectors of one scope and length, as a written table.

    Rows whose vector or scope is null, or holds a null, take no part; a vector of norm 0 stays 0. Vectors of other
    lengths are blocks of their own, and meet only queries of their length.
    """
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull())
    for c in scope:
        whole = whole & F.col(c).isNotNull()
    rows = vectors.filter(whole).select(*scope, F.col(key).alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    kind = rows.schema["id"].dataType
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in scope)
    return materialize(rows.mapInArrow(_packer(scope, to_arrow_type(kind)), f"{types}, dim int, ids array<{kind.simpleString()}>, matrix binary"), label)


def _heaps(limit: int, tol: float, apart: bool, least: float | None, key: str, kinds: tuple[pa.DataType, pa.DataType]):
    """Each query's best rows of a group: by rounded score, then id, and with ``tol`` all that come as near to the last of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        dims = left.column("dim").to_pylist()
        blocks = [(np.array(ids, object if isinstance(ids[0], str) else None), np.frombuffer(m, "<f8").reshape(len(ids), d)) for ids, m, d in zip(left.column("ids").to_pylist(), left.column("matrix").to_pylist(), dims, strict=True)]
        for asked, m in zip(right.column("ids").to_pylist(), right.column("matrix").to_pylist(), strict=True):
            queries = np.frombuffer(m, "<f8").reshape(len(asked), -1)
            held = [(np.empty(0), []) for _ in asked]
            floor = np.full(len(asked), -np.inf if least is None else least)
            for ids, matrix in blocks:
                scores = np.floor(queries @ matrix.T * ROUNDED + 0.5) / ROUNDED
                for q in np.flatnonzero((scores >= floor[:, None] - tol).any(axis=1)):
                    at = np.flatnonzero(scores[q] >= floor[q] - tol)
                    if apart:
                        at = at[ids[at] != asked[q]]
                    if least is not None:
                        at = at[scores[q, at] >= least]
                    s, i = np.concatenate([held[q][0], scores[q, at]]), [*held[q][1], *ids[at].tolist()]
                    if len(s) > limit:
                        order = sorted(range(len(s)), key=lambda j: (-s[j], i[j]))
                        last = s[order[limit - 1]]
                        floor[q] = max(floor[q], last)
                        order = order[:limit] if not tol else [j for k, j in enumerate(order) if k < limit or s[j] >= last - tol]
                        s, i = s[order], [i[j] for j in order]
                    held[q] = s, i
            for q, (s, i) in zip(asked, held, strict=True):
                out[0].extend([q] * len(i))
                out[1].extend(i)
                out[2].extend(s.tolist())
        return pa.table({"query_id": pa.array(out[0], kinds[0]), key: pa.array(out[1], kinds[1]), "score": pa.array(out[2], pa.float64())})

    return run


def _dealt(blocks: DataFrame, scope: list[str], other: str, own: str) -> tuple[DataFrame, DataFrame]:
    """(blocks with ``own``, scopes of several parts with their number): a scope of more than GROUP_BYTES is dealt to parts; those are at most HOT_SCOPES, or 64 MB each."""
    each = blocks.groupBy(*scope, "dim").agg(F.sum(F.length("matrix")).alias("bytes"))
    total = each.agg(F.sum("bytes")).first()[0] or 0
    least = max(GROUP_BYTES, total // HOT_SCOPES)
    large = F.broadcast(each.filter(F.col("bytes") > least).select(*scope, "dim", F.ceil(F.col("bytes") / GROUP_BYTES).cast("int").alias(f"{own}s")))
    part = F.pmod(F.xxhash64(F.element_at("ids", 1).cast("string")), F.coalesce(f"{own}s", F.lit(1))).cast("int")
    return blocks.join(large, [*scope, "dim"], "left").withColumn(own, part).drop(f"{own}s"), large


def best_in_scope(blocks: DataFrame, queries: DataFrame, scope: list[str], limit: int, key: str, tol: float = 0.0, apart: bool = True, least: float | None = None) -> DataFrame:
    """(query_id, key, score): of each group of blocks the ``limit`` best rows for each query of its scope, and those within ``tol`` of the last.

    ``blocks`` and ``queries`` come from ``pack_vectors`` over the same scope. A query's best rows over all groups are
    among them; ``apart`` leaves out the row of the query's own id, ``least`` those of a smaller score. Scores are rounded to six places.
    """
    on = [*scope, "dim"]
    left, parts = _dealt(blocks, scope, "pack", "part")
    right, packs = _dealt(queries.select(*on, F.col("ids"), "matrix"), scope, "part", "pack")
    spread = lambda df, to, name: df.join(to, on, "left").withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(f"{name}s", F.lit(1)) - 1))).drop(f"{name}s")
    left, right = spread(left, packs, "pack"), spread(right, parts, "part")
    own: DataType = blocks.schema["ids"].dataType.elementType
    asked: DataType = queries.schema["ids"].dataType.elementType
    by = [*on, "part", "pack"]
    run = _heaps(limit, tol, apart, least, key, (to_arrow_type(asked), to_arrow_type(own)))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"query_id {asked.simpleString()}, `{key}` {own.simpleString()}, score double")
