"""An approximate vector leg over inverted lists: cells by k-means, residuals by product quantisation, probing ended by a bound.

A vector x of a cell with centre c has the residual r = x - c, stored as a short code r' and the error e = |r - r'|. For
a query q of length 1, q.x lies within e of q.c + q.r', and no row of a cell beats q.c by more than the cell's radius.
A first round probes the nearest cells that hold enough rows of the query's scope and gives its kth best score so far; a second
round probes every further cell whose bound reaches that score. In both, only rows whose code may reach it are scored exactly.
``slack`` scales errors and radii: 1 gives the exact answer, less gives up rows that would need an unlikely direction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessarine.operators.vectors import ROUNDED, _unit, pack_vectors
from tessarine.shared import materialize

MAX_CELLS, SUBSPACES, CODES = 4096, 16, 256
SAMPLE_ROWS, SAMPLE_NUMBERS = 100_000, 1 << 24
"""Cells and codes are learnt on the driver from a sample by hash of at most so many rows and numbers (128 MB); every row is coded."""
TOGETHER, PAIRS = 2048, 1 << 20
"""Rows of a list that meet the queries at a time, and about how many pairs of both."""
ROUNDS = 10
ENOUGH = 2
"""The first round probes cells until they hold ENOUGH times the asked rows."""


def n_cells(rows: int) -> int:
    """The root of the number of rows, MAX_CELLS at most."""
    return int(max(1, min(MAX_CELLS, round(rows**0.5))))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(points), np.int64), (centres * centres).sum(axis=1) / 2
    for at in range(0, len(points), 4096):
        out[at : at + 4096] = (points[at : at + 4096] @ centres.T - half).argmax(axis=1)
    return out


def _means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres; one that loses all its points starts again at a random one."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        of = _nearest(points, centres)
        sizes = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points[rng.integers(0, len(points), len(centres))])
    return centres


class Quantiser:
    """Centres of cells, and a code book for each part of the residuals' dimensions."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.centres = _means(sample, cells, rng)
        left = sample - self.centres[_nearest(sample, self.centres)]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.books = [_means(np.ascontiguousarray(left[:, p]), CODES, rng) for p in self.parts]

    def encode(self, vectors: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, errors, lengths of residuals) of vectors of one cell."""
        left = vectors - self.centres[cell]
        codes = np.stack([_nearest(np.ascontiguousarray(left[:, p]), b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(left - back, axis=1), np.linalg.norm(left, axis=1)

    def estimates(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """(queries, rows): scores by code."""
        back = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return queries @ (self.centres[cell] + back).T


def _whole(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull()))


def fit(vectors: DataFrame, key: str, seed: int = 7) -> Quantiser | None:
    """The quantiser of a table of vectors of one length; None without rows."""
    rows = _whole(vectors)
    n, dims, most = rows.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not n:
        return None
    if dims != most:
        raise ValueError("vectors of one length are needed")
    share = max(1, -(-n // max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, dims)))))
    sample = rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(share)) == 0).select(F.transform("embedding", lambda v: v.cast("double")).alias("v")).limit(2 * SAMPLE_NUMBERS // max(1, dims)).toArrow()
    if not len(sample):
        return fit(vectors.limit(1), key, seed)
    flat = sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort(flat.reshape(-1, dims).T[::-1])
    return Quantiser(_unit(flat.reshape(-1, dims)[order]), n_cells(n), seed)


def _together(lists: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, codes, errors) of the blocks of a list, which each task packed for itself, joined to runs of TOGETHER rows."""

    def joined(waiting: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = [x for own, *_ in waiting for x in own]
        held = np.empty(len(ids), object)
        held[:] = ids
        matrix, codes, errors = (np.frombuffer(b"".join(w[i] for w in waiting), kind) for i, kind in ((1, "<f8"), (2, np.uint8), (3, "<f8")))
        return held, matrix.reshape(len(ids), -1), codes.reshape(len(ids), -1), errors

    waiting, size = [], 0
    for block in zip(*(lists.column(c).to_pylist() for c in ("ids", "matrix", "codes", "errors")), strict=True):
        waiting.append(block)
        size += len(block[0])
        if size >= TOGETHER:
            yield joined(waiting)
            waiting, size = [], 0
    if waiting:
        yield joined(waiting)


def _cut(asked: np.ndarray, scores: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``limit`` best rows, ties by id."""
    if not len(ids):
        return asked, scores, ids
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores, asked))
    asked, scores, ids = asked[order], scores[order], ids[order]
    rank = np.arange(len(asked)) - np.searchsorted(asked, asked)
    return asked[rank < limit], scores[rank < limit], ids[rank < limit]


class CellStore:
    """Inverted lists of a table of vectors: blocks of one scope and cell with ids, codes, errors and, for exact scores, vectors."""

    def __init__(self, vectors: DataFrame, scope: list[str], key: str = "chunk_id", seed: int = 7, path: str | None = None) -> None:
        self.scope, self.key, spark = scope, key, vectors.sparkSession
        self.quantiser = fit(vectors, key, seed)
        if self.quantiser is None:
            self.lists = self.held = None
            return
        self.shared = spark.sparkContext.broadcast(self.quantiser)
        shared, schema = self.shared, vectors.select(*scope, key, F.transform("embedding", lambda v: v.cast("double")).alias("embedding")).schema
        dims = self.quantiser.centres.shape[1]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                yield batch.append_column("cell", pa.array(_nearest(_unit(flat), shared.value.centres).astype(np.int32)))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shared.value.encode(np.frombuffer(m, "<f8").reshape(-1, dims), c) for m, c in zip(batch.column("matrix").to_pylist(), batch.column("cell").to_pylist(), strict=True)]
                batch = batch.append_column("codes", pa.array([c.tobytes() for c, _, _ in found], pa.binary()))
                batch = batch.append_column("errors", pa.array([e.astype("<f8").tobytes() for _, e, _ in found], pa.binary()))
                yield batch.append_column("radius", pa.array([float(r.max(initial=0)) for _, _, r in found], pa.float64()))

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        rows = _whole(vectors).select(*scope, key, F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
        packed = pack_vectors(rows.mapInArrow(place, types + ", cell int"), [*scope, "cell"], key, "lists")
        made = packed.mapInArrow(coded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema) + ", codes binary, errors binary, radius double")
        if path is None:
            self.lists = materialize(made, "cells")
        else:
            made.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
            self.lists = spark.read.parquet(path).select(made.columns)
        held = self.lists.groupBy(*scope, "cell").agg(F.sum(F.size("ids")).alias("n"), F.max("radius").alias("radius"))
        self.held = materialize(held.groupBy(*scope).agg(F.collect_list(F.struct("cell", "n", "radius")).alias("cells")), "held")  # MAX_CELLS entries to a scope

    def _probes(self, asked: DataFrame, limit: int, slack: float) -> DataFrame:
        """(scope, cell, query_id, embedding, floor) of the cells to probe: in the first round (no floor) the nearest, then all others whose bound reaches the floor."""
        shared, names = self.shared, [*self.scope, "cell", "query_id", "embedding", "floor"]

        def out(batch: pa.RecordBatch, units: np.ndarray, taken: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            at = np.repeat([i for i, _ in taken], [len(c) for _, c in taken]).astype(np.int64)
            q = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * units.shape[1], pa.int32()), pa.array(units[at].ravel()))
            cells = np.concatenate([c for _, c in taken])
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in self_scope), pa.array(cells, pa.int32()), batch.column("query_id").take(pa.array(at)), q, batch.column("floor").take(pa.array(at))], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units, taken, size = np.empty((len(batch), shared.value.centres.shape[1])), [], 0
                for i, (v, there, floor) in enumerate(zip(batch.column("embedding").to_pylist(), batch.column("cells").to_pylist(), batch.column("floor").to_pylist(), strict=True)):
                    unit = units[i] = _unit(np.array([v], float))[0]
                    cell, n, radius = (np.array([x[c] for x in there]) for c in ("cell", "n", "radius"))
                    near = shared.value.centres[cell] @ unit
                    order = np.lexsort((cell, -(near + slack * radius)))
                    before = np.cumsum(n[order]) - n[order]
                    first = before < ENOUGH * limit
                    take = order[first] if floor is None else order[~first & ((near + slack * radius)[order] >= floor)]
                    taken.append((i, cell[take]))
                    size += len(take)
                    if size * units.shape[1] >= PAIRS:
                        yield out(batch, units, taken)
                        taken, size = [], 0
                if size:
                    yield out(batch, units, taken)

        self_scope = list(self.scope)
        types = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in self.scope)
        met = asked.join(self.held, self.scope)
        return met.mapInArrow(run, f"{types}, cell int, query_id {asked.schema['query_id'].dataType.simpleString()}, embedding array<double>, floor double")

    def _scored(self, probes: DataFrame, limit: int, slack: float) -> DataFrame:
        """(query_id, key, score, scored): best rows of each list, and with a null key how many rows were scored exactly for how many seen."""
        shared, key = self.shared, self.key

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            id_type, asked_type = left.schema.field("ids").type.value_type, right.schema.field("query_id").type
            if not (len(left) and len(right)):
                return pa.table({"query_id": pa.nulls(0, asked_type), key: pa.nulls(0, id_type), "score": pa.nulls(0, pa.float64()), "scored": pa.nulls(0, pa.int64()), "seen": pa.nulls(0, pa.int64())})
            names, q = right.column("query_id").combine_chunks(), right.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(right), -1)
            floors = right.column("floor").fill_null(-np.inf).to_numpy()
            asked, scored, seen = np.array(names.to_pylist(), object), np.zeros(len(q), np.int64), 0
            best = np.empty(0, np.int64), np.empty(0, np.float64), np.empty(0, object)
            for ids, matrix, codes, errors in _together(left):
                seen += len(ids)
                for at in range(0, len(q), step := max(1, PAIRS // len(ids))):
                    own = slice(at, at + step)
                    near, least = shared.value.estimates(q[own], left.column("cell")[0].as_py(), codes), floors[own]
                    if len(ids) > limit + 1:  # one of them may be the query's own row
                        least = np.maximum(least, np.partition(near - slack * errors, len(ids) - limit - 1, axis=1)[:, len(ids) - limit - 1])
                    i, j = np.nonzero(near + slack * errors >= least[:, None] - 1 / ROUNDED)
                    scored[own] += np.bincount(i, minlength=len(near))
                    exact = np.concatenate([np.einsum("nd,nd->n", q[own][i[k : k + PAIRS // 64]], matrix[j[k : k + PAIRS // 64]]) for k in range(0, len(i), PAIRS // 64)] or [np.empty(0)])
                    other = ids[j] != asked[own][i]
                    new = (i + at)[other], np.floor(exact[other] * ROUNDED + 0.5) / ROUNDED, ids[j[other]]
                    best = _cut(*(np.concatenate(x) for x in zip(best, new, strict=True)), limit)
            n = len(best[0])
            return pa.table(
                {"query_id": pa.concat_arrays([names.take(pa.array(best[0])), names]), key: pa.array([*best[2].tolist(), *[None] * len(q)], id_type), "score": pa.concat_arrays([pa.array(best[1], pa.float64()), pa.nulls(len(q), pa.float64())]),
                 "scored": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(scored)]), "seen": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.full(len(q), seen))])}
            )

        by = [*self.scope, "cell"]
        kinds = probes.schema["query_id"].dataType.simpleString(), self.lists.schema["ids"].dataType.elementType.simpleString()
        return self.lists.groupBy(*by).cogroup(probes.groupBy(*by)).applyInArrow(run, f"query_id {kinds[0]}, `{key}` {kinds[1]}, score double, scored long, seen long")

    def search(self, queries: DataFrame, limit: int, slack: float = 0.25) -> tuple[DataFrame, DataFrame]:
        """((query_id, key, score, rank), (query_id, scored, seen): rows scored exactly, and by code, for each query).

        A query sees rows of its scope alone, never the row of its own id, and gets as many as the exact leg would give.
        """
        kind = queries.schema["query_id"].dataType.simpleString()
        if self.lists is None:
            spark = queries.sparkSession
            return spark.createDataFrame([], f"query_id {kind}, `{self.key}` long, score double, rank long"), spark.createDataFrame([], f"query_id {kind}, scored long, seen long")
        asked = _whole(queries).filter(F.size("embedding") == self.quantiser.centres.shape[1]).select(*self.scope, "query_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
        first = materialize(self._scored(self._probes(asked.withColumn("floor", F.lit(None).cast("double")), limit, slack), limit, slack), "first-probes")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        ranked = lambda df: df.filter(F.col(self.key).isNotNull()).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
        floors = ranked(first).filter(F.col("rank") == limit).select("query_id", F.col("score").alias("floor"))
        again = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        rest = materialize(self._scored(self._probes(again.select(*asked.columns, "floor"), limit, slack), limit, slack), "more-probes")
        every = first.unionByName(rest)
        stats = every.filter("scored IS NOT NULL").groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("seen").alias("seen"))
        return ranked(every).select("query_id", self.key, "score", "rank"), stats
