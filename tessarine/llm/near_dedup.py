"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document's signature holds 36 MinHash values of 16 bits. It is cut into 9 chunks of 4 values, and each chunk is
indexed once for every place where it may be wrong. Two signatures that differ in at most 17 places have, by the
pigeonhole principle, a chunk with at most one error, and so share an index entry: no such pair is missed. (At a
similarity of exactly 0.75 a pair shares none with probability 0.262^9, six in a million.) Candidates are confirmed
on the full shingle sets.

Groups of copies never become all their pairs. Equal sets are one class from the start. In each index entry every
class has a hub, and a class is first compared with the hub of its largest entry. Where the classes of an entry are then still in different components, a class can only share
with another component such shingles as occur there; classes and pairs for which these are too few drop out. The rest meet
other hubs, which joins most of what belongs together, and what is then left is compared across components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm._text import hashed_words, mix, ngrams, slices
from tessarine.llm._work import HOT_PARTS, join_counted, materialize

SHINGLE = 5
PERCENT = 75
CHUNKS, WIDTH = 9, 4
SPLIT_ABOVE = 256
"""Index entries with more classes than this are compared in several blocks."""
HUB_TURNS = 2
"""Rounds that compare each class with one other of each of its index entries, before all that are left are compared."""
BITMAP_BITS = 1024
"""Before full sets are compared across components, bitmaps bound what they share: a bit that only one of them has stands for at least one shingle that the other lacks. No link is lost."""
BROADCAST_IDS = 2_000_000
SLICE_BYTES = 16 << 20

_K = CHUNKS * WIDTH
_rng = np.random.default_rng(20_011)
_MUL = _rng.integers(0, 2**63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, _K, dtype=np.uint64)


def _signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(_K, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _MUL + _ADD).min(axis=0))
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def _class_of(shingles: np.ndarray) -> int:
    """64-bit digest of a set (sorted array): different sets share it with probability 2^-64."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def _shingle_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for some in slices(batch, "text", SLICE_BYTES):
        hashes, borders = hashed_words(some.column("text"))
        yield from (np.unique(ngrams(hashes[a:b], SHINGLE)) for a, b in zip(borders[:-1], borders[1:], strict=True))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, classes, signatures = [], [], []
        for found in _shingle_sets(batch):
            sizes.append(len(found))
            classes.append(_class_of(found) if len(found) else None)
            signatures.append(_signature(found).tobytes() if len(found) else None)
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(signatures, pa.binary())],
            ["doc_id", "n_shingles", "cls", "sig"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            found = list(_shingle_sets(batch.slice(at, 512)))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.record_batch(
                [pa.array([_class_of(x) for x in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cls", "shingles"]
            )


def _chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * WIDTH): each chunk with each of its values left out, with the place in the top bits."""
    part = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(signatures), CHUNKS, WIDTH), np.uint64)
    for wrong in range(WIDTH):
        a, b, c = (part[:, :, i] for i in range(WIDTH) if i != wrong)
        place = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(wrong)) << np.uint64(48)
        out[:, :, wrong] = place | (a << np.uint64(32)) | (b << np.uint64(16)) | c
    return out.reshape(len(signatures), -1)


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(len(batch), _K)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2048):
            some = batch.slice(at, 2048)
            keys = _chunk_keys(_signatures(some))
            yield pa.record_batch(
                [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(some.column("cls").to_numpy(zero_copy_only=False), keys.shape[1]))], ["key", "cls"]
            )


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, shingles) -> a bitmap with the bit of each shingle, as longs."""
    for batch in batches:
        out = np.zeros((len(batch), BITMAP_BITS), np.uint8)
        for row, found in zip(out, batch.column("shingles"), strict=True):
            row[mix(found.values.to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(BITMAP_BITS - 1)] = 1
        flat = np.packbits(out, axis=1).ravel().view(np.int64)
        ends = np.arange(len(out) + 1, dtype=np.int32) * (BITMAP_BITS // 64)
        yield pa.record_batch([batch.column("cls"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cls", "bits"])


def _ids(df: DataFrame) -> DataFrame:
    """Mark for broadcast when counted small enough; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _sets_of(classes: DataFrame, docs: DataFrame, firsts: DataFrame, repeated_ids: bool) -> DataFrame:
    """(cls, shingles) of the given classes, from the whole text of each class's first document."""
    wanted = materialize(firsts.join(classes.select("cls"), "cls", "left_semi").select("doc_id").distinct(), "wanted")
    texts = docs.select("doc_id", "text").join(_ids(wanted), "doc_id", "left_semi")
    sets = texts.mapInArrow(_full_sets, "cls long, shingles array<long>")
    return materialize(sets.dropDuplicates(["cls"]) if repeated_ids else sets, "sets")


def _beside(rows: DataFrame, facts: DataFrame, side: str, other: str, counted: DataFrame, total: int) -> DataFrame:
    """``rows`` (side, other, ...) with the row of ``facts`` (cls, ...) for the class in column ``side``.

    ``counted`` holds the same values of ``side`` as ``rows``. A class in 1/HOT_PARTS of ``total`` rows is one of at
    most 2 * HOT_PARTS; its rows are dealt to blocks by column ``other`` and its facts repeated for each block.
    """
    least = max(SPLIT_ABOVE, total // HOT_PARTS)
    often = counted.groupBy(side).agg(F.count(F.lit(1)).alias("n_pairs")).filter(F.col("n_pairs") >= least)
    hot = F.broadcast(often.select(side, F.ceil(F.col("n_pairs") / least).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64(other), F.col("blocks")).cast("int")
    dealt = rows.join(hot, side, "left").withColumn("block", F.coalesce(block, F.lit(0))).drop("blocks")
    each = facts.withColumnRenamed("cls", side).join(hot, side, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return dealt.join(each, [side, "block"]).drop("block")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes, a written table, those whose full sets link."""
    total = pairs.count()
    left = _beside(pairs, sets.select("cls", F.col("shingles").alias("of_a")), "a", "b", pairs, total)
    both = _beside(left, sets.select("cls", F.col("shingles").alias("of_b")), "b", "a", pairs, total)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    linked = 100 * shared >= PERCENT * (F.size("of_a") + F.size("of_b") - shared)
    return both.filter(linked).select("a", "b").distinct()


def _followed(up: DataFrame, to: DataFrame, total: int) -> DataFrame:
    """``up`` (node, root), each root replaced by its own root in ``to`` (node, root), which holds every root of ``up``."""
    step = to.select(F.col("node").alias("cls"), F.col("root").alias("next"))
    return _beside(up, step, "root", "node", up, total).select("node", F.col("next").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b), a written table: root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows pointers once and contracts; a path of n nodes
    takes about log n rounds. Rows of a node with many neighbours, or of a root of many nodes, are dealt to blocks.
    """
    found, total = None, 2 * edges.count()
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooked")
        up = materialize(_followed(up, up, total), "roots")
        if found is None:
            found = up
        else:
            # roots that met no other root keep themselves
            still = found.select(F.col("root").alias("node")).distinct().join(up.select("node"), "node", "left_anti")
            found = materialize(_followed(found, up.union(still.select("node", F.col("node").alias("root"))), total), "roots")
        near = _beside(edges, up.select(F.col("node").alias("cls"), F.col("root").alias("x")), "a", "b", edges, total)
        near = _beside(near, up.select(F.col("node").alias("cls"), F.col("root").alias("y")), "b", "a", edges, total)
        edges = materialize(near.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return found


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, root) after some more links (a, b), a written table: only the roots that these join are followed again."""
    if links.isEmpty():
        return roots
    if roots is None:
        return components(links)
    of = lambda side, name: roots.select(F.col("node").alias(side), F.col("root").alias(name))
    met = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    edges = materialize(met.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return roots
    up = components(edges)
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialize(moved.unionByName(up.join(roots.select("node"), "node", "left_anti")), "roots")


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("cls"))
    return members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _alike_size() -> F.Column:
    return 100 * F.least("n_shingles", "of_n") >= PERCENT * F.greatest("n_shingles", "of_n")


def _in_reach(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, reach): how many of a class's shingles any class of another root has.

    No class of another root can share more than that, so classes with reach below 3/4 of their size are done.
    """
    each = sets.join(opened, "cls").select("cls", "root", F.explode("shingles").alias("shingle"))
    spread = each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n_rows"))
    spread = materialize(spread.filter("low < high").select("shingle", "n_rows"), "spread")
    total = spread.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return join_counted(each, spread, "shingle", total).groupBy("cls").agg(F.count(F.lit(1)).alias("reach"))


def _of_entry(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` (key, cls, blocks, ...) with the row of ``entries`` (key, blocks, ...) for their key.

    An entry's rows are dealt to its blocks, so a large one spreads over many tasks.
    """
    each = entries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).join(each, ["key", "block"]).drop("block")


def _hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each class against one class of each other component that it shares keys with, another in each turn: linear in the rows."""
    hub = F.struct(F.col("cls").alias("of"), F.col("root").alias("of_root"), F.col("n_shingles").alias("of_n"), F.col("reach").alias("of_reach"))
    hubs = rows.groupBy("key").agg(F.max("blocks").alias("blocks"), F.min_by(hub, F.xxhash64("key", "cls", F.lit(turn))).alias("hub"))
    met = _of_entry(rows, hubs.select("key", "blocks", "hub.*")).filter((F.col("root") != F.col("of_root")) & _may_link())
    met = met.groupBy("cls", "of_root").agg(F.min_by("of", F.xxhash64("of", F.lit(turn))).alias("of"))
    return met.select(F.least("cls", "of").alias("a"), F.greatest("cls", "of").alias("b")).distinct()


def _may_link() -> F.Column:
    overlap = (100 + PERCENT) * F.least("reach", "of_reach") >= PERCENT * (F.col("n_shingles") + F.col("of_n"))
    return overlap & _alike_size()


def _across(rows: DataFrame) -> DataFrame:
    """Pairs within a key whose roots differ, whose sizes are near enough and whose reaches allow a link.

    Of each pair one row isn't of the key's most frequent root, so those rows alone meet all of the key. A key's rows
    are dealt to blocks of about twice SPLIT_ABOVE and each block is a join key of its own, so one large
    entry spreads over many tasks. Pairs that can't link are dropped inside the join, and a pair that shares several
    keys leaves it once, at the first of them.
    """
    of_root = rows.groupBy("key", "root").agg(F.max("blocks").alias("blocks"), F.count(F.lit(1)).alias("rows"))
    of_key = of_root.groupBy("key").agg(F.max("blocks").alias("blocks"), F.max_by("root", F.struct("rows", "root")).alias("most"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("roots"))
    sized = _of_entry(rows, of_key.filter("roots > 1").drop("roots"))
    blocks = F.ceil(F.col("rows") / (2 * SPLIT_ABOVE)).cast("int")
    dealt = sized.select("key", "cls", "root", "most", "n_shingles", "reach", "bits", "keys", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))
    left = dealt.filter("root <> most").drop("block", "most").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = dealt.select(
        "key", F.col("cls").alias("of"), F.col("root").alias("of_root"), F.col("n_shingles").alias("of_n"), F.col("reach").alias("of_reach"), F.col("bits").alias("of_bits"), F.col("keys").alias("of_keys"),
        (F.col("root") == F.col("most")).alias("of_most"), "block",
    )
    lone = sum((F.bit_count(F.get("bits", i).bitwiseAND(F.bitwise_not(F.get("of_bits", i)))) for i in range(BITMAP_BITS // 64)), F.lit(0))
    near = (100 + PERCENT) * (F.col("n_shingles") - lone) >= PERCENT * (F.col("n_shingles") + F.col("of_n"))
    first = F.array_min(F.array_intersect("keys", "of_keys")) == F.col("key")
    once = F.col("of_most") | (F.col("cls") < F.col("of"))
    met = left.join(right, ["key", "block"]).filter(once & (F.col("root") != F.col("of_root")) & _may_link() & near & first)
    return met.select(F.least("cls", "of").alias("a"), F.greatest("cls", "of").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, other columns ignored).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set is the distinct 5-word shingles, or the whole
    sequence when there are fewer words. Documents link when 100 * shared >= 75 * united. Null, empty and blank texts
    have no shingles and stay alone. A null doc_id stays alone too: its component_id is null and kept is true.
    Repeated rows all come back, with the same answer. No rows give no rows.
    """
    base = materialize(docs.select("doc_id", "text").mapInArrow(_sign, "doc_id long, n_shingles long, cls long, sig binary"), "signatures")
    part = base.filter("doc_id is not null and cls is not null")
    classes = materialize(part.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n_rows")), "classes")
    total, n_ids = part.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    repeated = n_ids < total

    entries = part.select("cls", "sig").mapInArrow(_index, "key long, cls long")
    hubs = materialize(entries.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("high"), F.count(F.lit(1)).alias("n_rows")).filter("hub < high").drop("high"), "hubs")
    sized_hubs = hubs.withColumn("size", F.col("n_rows")).withColumn("blocks", F.ceil(F.col("n_rows") / SPLIT_ABOVE).cast("int"))
    members = materialize(join_counted(entries, sized_hubs, "key", total * _K).select("key", "cls", "hub", "size", "blocks").distinct(), "members")
    firsts = classes.select("cls", F.col("first_id").alias("doc_id"))
    size_of = classes.select("cls", "n_shingles")
    largest = F.max_by("hub", F.struct("size", "hub"))
    pairs = materialize(members.filter("cls <> hub").groupBy("cls").agg(largest.alias("a")).select("a", F.col("cls").alias("b")), "pairs")
    with_a = _beside(pairs, size_of, "a", "b", pairs, pairs.count())
    pairs = materialize(with_a.join(size_of.select(F.col("cls").alias("b"), F.col("n_shingles").alias("of_n")), "b").filter(_alike_size()).select("a", "b"), "pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), docs, firsts, repeated)
    roots = _merged(None, materialize(_linked(pairs, sets), "links"))

    rows = _rooted(members.select("key", "cls", "blocks"), roots)
    split = rows.groupBy("key").agg(F.max("blocks").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "blocks")
    open_ = materialize(_of_entry(rows, split), "open")
    if not open_.isEmpty():
        opened = materialize(open_.select("cls", "root").distinct(), "opened")
        sets = _sets_of(opened, docs, firsts, repeated)
        reach = materialize(_in_reach(opened, sets).join(size_of, "cls").filter(100 * F.col("reach") >= PERCENT * F.col("n_shingles")), "reach")
        bitmaps = sets.join(reach.select("cls"), "cls").mapInArrow(_bitmap, "cls long, bits array<long>").dropDuplicates(["cls"])
        own = open_.groupBy("cls").agg(F.sort_array(F.collect_list("key")).alias("keys"))
        marked = materialize(reach.join(bitmaps, "cls").join(own, "cls"), "marked")
        rows = open_.drop("root").join(reach, "cls")
        for turn in range(HUB_TURNS + 1):
            rooted = _rooted(rows, roots)
            found = _hub_pairs(rooted, turn) if turn < HUB_TURNS else _across(rooted.join(marked.select("cls", "bits", "keys"), "cls"))
            fresh = materialize(found.join(pairs, ["a", "b"], "left_anti"), "pairs")
            if fresh.isEmpty():
                continue
            pairs = pairs.union(fresh)
            roots = _merged(roots, materialize(_linked(fresh, sets), "links"))

    answer = _rooted(classes, roots)
    ids = answer.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_rows"))
    of_class = answer.select("root", "cls", F.col("n_rows").alias("copies"))
    answer = materialize(join_counted(of_class, ids, "root", total).select("cls", "component_id", F.col("copies").alias("n_rows")), "answer")
    alone = base.filter("doc_id is null or cls is null").withColumn("component_id", F.col("doc_id")).drop("cls", "sig")
    done = join_counted(part.drop("sig"), answer, "cls", total).drop("cls").unionByName(alone)
    return done.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without rows whose document is not the first of its component; equal rows of one doc_id become one.

    Rows that share a doc_id but differ all stay or all go, and rows without one all stay.
    """
    verdict = near_duplicates(docs)
    gone = materialize(verdict.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.join(_ids(gone), "doc_id", "left_anti")
    again = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "again")
    if again.isEmpty():
        return left.select(docs.columns)
    once = left.join(_ids(again), "doc_id", "left_semi").dropDuplicates()
    return left.join(_ids(again), "doc_id", "left_anti").unionByName(once).select(docs.columns)
