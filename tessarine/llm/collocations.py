"""Phrases that stand together more often than their parts explain, by mergeable Misra-Gries summaries.

The n-grams of all texts are dealt by hash to partitions. Each task keeps a summary per partition with more counters
than the partition's mass divided by the threshold; when one is over capacity, the largest count that would not fit is
taken from all counters. Summaries of tasks are added and cut again. All cuts of a partition together take less than
the threshold from a counter, so every n-gram that is frequent enough survives. A second pass counts survivors exactly.

Words are counted before, and an n-gram with a word under the threshold is left out of the summaries: it can't reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessarine.llm._text import _STEP, Cut, mix, slices
from tessarine.llm._work import free, join_counted, materialize

BLANKS, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
SLICE_BYTES, COUNT_BYTES = 4 << 20, 8 << 20
"""Bytes of text, or one text, that a task hashes, or counts, at a time."""
PART_BYTES, MOST_PARTS = 4 << 20, 20_000
"""A hash partition for each PART_BYTES of text, MOST_PARTS at most."""
NARROW = 1 << 28
"""Up to so many bytes of text to a partition, and about as many n-grams, 32 bits tell its n-grams apart, else 64. Two n-grams of one key can only make a false survivor."""
BUFFER, HELD = 1 << 21, 3 << 20
"""Hashes, or counters, that a task gathers before it sorts them, or sends them on."""
ROWS = 1 << 20
"""Phrases that a task adds up before it sends them on."""
PROBES, BITS_EACH, MOST_BITS, SEGMENT = 3, 16, 1 << 29, 1 << 19
"""The filter of survivors has 16 bits for each, 2^29 (64 MB) at most: a fuller filter lets more be counted, never less."""
TOP_SALTS = 256

_SUMMARY = "part int, keys binary, counts binary, error long"


def _grams(cut: Cut, seeds: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the n-grams from each word on); those that leave their piece are dropped by ``whole``."""
    words = cut.hashes()
    h = mix(words + seeds[cut.row])
    for n in range(1, most + 1):
        if n > 1:
            h = mix(h[:-1] * _STEP + words[n - 1 :]) if len(h) > 1 else h[:0]
        yield n, h


def whole(cut: Cut, n: int) -> np.ndarray:
    """Whether the n words from each place on stand in one piece."""
    return cut.piece[: max(0, len(cut.piece) - n + 1)] == cut.piece[n - 1 :]


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, which one each row has, a hash for each row, unlike that of a word: words named like languages would share sums)."""
    found = batch.column("lang").dictionary_encode()
    names = found.dictionary.to_pylist()
    of_row = found.indices.to_numpy(zero_copy_only=False)
    return names, of_row, np.fromiter((xxhash.xxh3_64_intdigest(n.encode(), 1) for n in names), np.uint64, len(names))[of_row]


class Keys:
    """How hashes become keys: the partition in the upper bits, so that keys in order are partitions in order."""

    def __init__(self, parts: int, wide: bool) -> None:
        self.parts, self.wide, self.kind = parts, wide, "<u8" if wide else "<u4"

    def part(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)

    def of(self, h: np.ndarray) -> np.ndarray:
        return h if self.wide else (self.part(h) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))

    def parts_of(self, keys: np.ndarray) -> np.ndarray:
        return (self.part(keys) if self.wide else keys >> np.uint64(32)).astype(np.int64)

    def packed(self, keys: np.ndarray) -> bytes:
        """Keys of one partition in order, as steps from one to the next, byte by byte: what is written compresses these well."""
        steps = np.diff(keys if self.wide else keys & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype(self.kind)
        return np.ascontiguousarray(steps.view(np.uint8).reshape(len(keys), -1).T).tobytes()

    def unpacked(self, part: int, raw: bytes) -> np.ndarray:
        width = int(self.kind[2])
        steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(self.kind).ravel()
        own = np.cumsum(steps.astype(np.uint64), dtype=np.uint64)
        return own if self.wide else own | np.uint64(part << 32)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def cut_down(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Counters less the largest that doesn't fit, and what was taken from each; those at or under zero are no longer held."""
    if len(counts) <= capacity:
        return counts, 0
    taken = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    return counts - taken, taken


class Summaries:
    """Misra-Gries summaries of all hash partitions of a task's n-grams."""

    def __init__(self, keys: Keys, capacity: np.ndarray) -> None:
        self.of, self.capacity = keys, capacity
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.errors = np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(self.capacity), np.int64)

    def add(self, hashes: np.ndarray) -> None:
        k = np.sort(self.of.of(hashes))
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(k)))
        self.keys, self.counts = added(np.concatenate([self.keys, k[first]]), np.concatenate([self.counts, n]))
        borders = np.searchsorted(self.of.parts_of(self.keys), np.arange(len(self.capacity) + 1))
        over = np.flatnonzero(np.diff(borders) > self.capacity)
        for p in over:
            own = slice(borders[p], borders[p + 1])
            self.counts[own], taken = cut_down(self.counts[own], int(self.capacity[p]))
            self.errors[p] += taken
        if len(over):
            keep = self.counts > 0
            self.keys, self.counts = self.keys[keep], self.counts[keep]

    def rows(self) -> pa.RecordBatch:
        parts = self.of.parts_of(self.keys)
        there = np.unique(np.concatenate([parts, np.flatnonzero(self.errors)]))
        a, b = np.searchsorted(parts, there), np.searchsorted(parts, there, "right")
        out = [{"part": int(p), "keys": self.of.packed(self.keys[i:j]), "counts": self.counts[i:j].astype("<u4").tobytes(), "error": int(self.errors[p])} for p, i, j in zip(there, a, b, strict=True)]
        self.clear()
        return pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("error", pa.int64())]))


class Filter:
    """A set of keys as a bitmap in a broadcast, which may hold others by mistake."""

    def __init__(self, bitmap, keys: Keys, bits: int) -> None:
        self.bitmap, self.keys, self.bits = bitmap, keys, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        keys, field = self.keys.of(h), np.frombuffer(self.bitmap.value, np.uint8)
        there = np.ones(len(keys), bool)
        left = np.arange(len(keys))
        for i in range(PROBES):
            at = _place(mix(keys[left]), i, self.bits)
            fine = (field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            there[left[~fine]] = False
            left = left[fine]
        return there


def _candidates(cut: Cut, seeds: np.ndarray, most: int, words: Filter) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of 2 words or more, all of which the filter holds."""
    fine = may = None
    for n, h in _grams(cut, seeds, most):
        if n == 1:
            fine = may = words.holds(h)
        else:
            may = may[: len(h)] & fine[n - 1 :][: len(h)]
            yield h[may & whole(cut, n)]


def _cuts(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, Cut]]:
    for batch in batches:
        for some in slices(batch, "text", size):
            yield *_languages(some), Cut(some.column("text"), BLANKS, BREAKS)


def _masses(most: int, parts: int, words: Filter):
    """(lang, null, words) and (null, part, candidate n-grams) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, size = np.zeros(parts, np.int64), {}
        for names, of_row, seeds, cut in _cuts(batches):
            for name, n in zip(names, np.bincount(of_row[cut.row], minlength=len(names)), strict=True):
                size[name] = size.get(name, 0) + int(n)
            for h in _candidates(cut, seeds, most, words):
                mass += np.bincount(words.keys.part(h).astype(np.int64), minlength=parts)
        there = np.flatnonzero(mass)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([*size, *[None] * len(there)], pa.string()), "part": pa.array([*[None] * len(size), *there.tolist()], pa.int32()), "n": pa.array([*size.values(), *mass[there].tolist()], pa.int64())})

    return run


def _summarise(most: int, keys: Keys, capacity: np.ndarray, words: Filter | None):
    """Summaries of the candidates, or without a filter of words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, size, mass = Summaries(keys, capacity), [], 0, 0
        for _, _, seeds, cut in _cuts(batches):
            for h in _candidates(cut, seeds, most, words) if words else (h for _, h in _grams(cut, seeds, 1)):
                waiting.append(h)
                size += len(h)
                if size >= BUFFER:
                    own.add(np.concatenate(waiting))
                    mass, waiting, size = mass + size, [], 0
                    if len(own.keys) > HELD or mass >= 1 << 31:
                        yield own.rows()
                        mass = 0
        if size:
            own.add(np.concatenate(waiting))
        yield own.rows()

    return run


def _survivors(keys: Keys, capacity: np.ndarray, least: int):
    """Merged summaries of rows in order of part: the keys that may stand ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, c, error, waiting = None, None, None, 0, 0

        def settle() -> None:
            nonlocal k, c, error, waiting
            one, n = added(np.concatenate(k), np.concatenate(c))
            n, taken = cut_down(n, int(capacity[part]))
            k, c, error, waiting = [one[n > 0]], [n[n > 0]], error + taken, 0

        def out() -> pa.RecordBatch:
            settle()
            found = k[0][c[0] + error >= least]
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "keys": pa.array([keys.packed(found)], pa.binary()), "n": pa.array([len(found)], pa.int64())})

        for batch in batches:
            for p, own, counts, e in zip(*(batch.column(x).to_pylist() for x in ("part", "keys", "counts", "error")), strict=True):
                if p != part:
                    if part is not None:
                        yield out()
                    part, k, c, error, waiting = p, [], [], 0, 0
                k.append(keys.unpacked(p, own))
                c.append(np.frombuffer(counts, "<u4").astype(np.int64))
                error, waiting = error + e, waiting + len(k[-1])
                if waiting > BUFFER:
                    settle()
        if part is not None:
            yield out()

    return run


def _place(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (h + np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def _bits(keys: Keys, bits: int):
    """(segment, places in it) of all survivors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                at = np.sort(np.concatenate([_place(mix(keys.unpacked(part, raw)), i, bits) for i in range(PROBES)]))
                seg = (at // np.uint64(SEGMENT)).astype(np.int64)
                there, first = np.unique(seg, return_index=True)
                cut = np.append(first, len(at))
                rows = [(at[a:b] % np.uint64(SEGMENT)).astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"segment": pa.array(there, pa.int32()), "places": pa.array(rows, pa.binary())})

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of segment become one bitmap each."""
    segment, field = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bitmap": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})

    for batch in batches:
        for s, places in zip(batch.column("segment").to_pylist(), batch.column("places").to_pylist(), strict=True):
            if s != segment:
                if segment is not None:
                    yield out()
                segment, field = s, np.zeros(SEGMENT, np.uint8)
            field[np.frombuffer(places, "<u4")] = 1
    if segment is not None:
        yield out()


def _same(cut: Cut, of_row: np.ndarray, h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct phrase, how often it stands), by hash, and by the words themselves where two phrases share one."""
    which = pa.array(h).dictionary_encode().indices.to_numpy()
    sizes = np.bincount(which)
    first = np.empty(len(sizes), np.int64)
    first[which] = at
    model = first[which]
    lang = of_row[cut.row]
    apart = lang[at] != lang[model]
    for j in range(n):
        apart |= cut.place[at + j] != cut.place[model + j]
    if not apart.any():
        return first, sizes
    shared = np.zeros(len(sizes), bool)
    shared[which[apart]] = True
    mixed = at[shared[which]]
    _, own, each = np.unique(np.stack([lang[mixed], *(cut.place[mixed + j] for j in range(n))], axis=1), axis=0, return_index=True, return_counts=True)
    return np.concatenate([first[~shared], mixed[own]]), np.concatenate([sizes[~shared], each])


def _added_up(tables: list[pa.Table], by: list[str]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(by, use_threads=False).aggregate([("n", "sum")])
    return whole.rename_columns([*by, "n"])


_PACKED = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])


def _pack(table: pa.Table) -> pa.RecordBatch:
    """A row for each part and language: its phrases in order, one to a line, compressed, and their counts."""
    table = table.sort_by([("part", "ascending"), ("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()
    part, lang = (table.column(c).combine_chunks() for c in ("part", "lang"))
    p, which = part.to_numpy(), lang.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (which[1:] != which[:-1])])) if len(p) else np.empty(0, np.int64)
    offsets = np.append(first, len(p))
    nothing, end = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    lines = pc.binary_join_element_wise(table.column("phrase").combine_chunks(), nothing, end)
    at, raw = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :], memoryview(lines.buffers()[2])
    zstd, n = pa.Codec("zstd"), table.column("n").to_numpy().astype("<i8")
    texts = [raw[at[a] : at[b] - 1] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    blobs = [len(x).to_bytes(8, "little") + zstd.compress(pa.py_buffer(x), asbytes=True) for x in texts]
    return pa.RecordBatch.from_arrays([part.take(pa.array(first)), lang.take(pa.array(first)), pa.array(blobs, pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], schema=_PACKED)


def _count(most: int, held: Filter):
    """Packed counts of the phrases that the filter holds with all their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, tables, size = ["part", "lang", "phrase"], [], 0
        for names, of_row, seeds, cut in _cuts(batches, COUNT_BYTES):
            before = None
            for n, h in _grams(cut, seeds, most):
                may = whole(cut, n)
                if before is not None and len(before):
                    may = may & before[:-1] & before[1:]
                at = np.flatnonzero(may)
                at = at[held.holds(h[at])]
                before = np.zeros(len(h), bool)
                before[at] = True
                if not len(at):
                    continue
                first, sizes = _same(cut, of_row, h[at], at, n)
                words = [cut.known.take(pa.array(cut.place[first + j])) for j in range(n)]
                phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if n > 1 else words[0]
                lang = pa.array(names, pa.string()).take(pa.array(of_row[cut.row[first]]))
                tables.append(pa.table({"part": pa.array(held.keys.part(h[first]).astype(np.int32)), "lang": lang, "phrase": phrase.cast(pa.large_string()), "n": pa.array(sizes.astype(np.int64))}))
                size += len(first)
            if size >= ROWS:
                tables = [_added_up(tables, by)]
                size = len(tables[0])
                if size >= ROWS // 2:
                    yield _pack(tables[0])
                    tables, size = [], 0
        if tables:
            yield _pack(_added_up(tables, by))

    return run


def _totals(least: int):
    """Rows of ``_pack`` in order of part: (lang, words, phrase, n) of those that stand ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tables, size, zstd = None, [], 0, pa.Codec("zstd")

        def out() -> pa.RecordBatch:
            whole = _added_up(tables, ["lang", "phrase"])
            whole = whole.filter(pc.greater_equal(whole.column("n"), least)).combine_chunks()
            phrase = whole.column("phrase").combine_chunks()
            words = pc.add(pc.count_substring(phrase, " ").cast(pa.int32()), pa.scalar(1, pa.int32()))
            return pa.RecordBatch.from_arrays([whole.column("lang").combine_chunks(), words, phrase.cast(pa.string()), whole.column("n").combine_chunks()], ["lang", "words", "phrase", "n"])

        for batch in batches:
            for p, lang, blob, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "phrases", "counts")), strict=True):
                if p != part:
                    if tables:
                        yield out()
                    part, tables, size = p, [], 0
                phrases = zstd.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True).decode().split("\n")
                tables.append(pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.large_string()), "n": pa.array(np.frombuffer(counts, "<i8"))}))
                size += len(phrases)
                if size >= ROWS:
                    tables = [_added_up(tables, ["lang", "phrase"])]
                    size = 0
        if tables:
            yield out()

    return run


def _filter_of(kept: DataFrame, keys: Keys) -> Filter:
    """The broadcast filter of a written table of survivors."""
    n, bits = kept.agg(F.sum("n")).first()[0] or 0, SEGMENT
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    field = bytearray(bits // 8)
    placed = kept.filter("n > 0").mapInArrow(_bits(keys, bits), "segment int, places binary").repartition("segment").sortWithinPartitions("segment")
    for r in placed.mapInArrow(_segments, "segment int, bitmap binary").toLocalIterator():  # MOST_BITS / 8 bytes at most
        field[r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = r["bitmap"]
    return Filter(kept.sparkSession.sparkContext.broadcast(bytes(field)), keys, bits)


def _kept(rows: DataFrame, most: int, keys: Keys, capacity: np.ndarray, least: int, words: Filter | None, label: str) -> DataFrame:
    made = rows.mapInArrow(_summarise(most, keys, capacity, words), _SUMMARY).repartition("part").sortWithinPartitions("part")
    return materialize(made.mapInArrow(_survivors(keys, capacity, least), "part int, keys binary, n long"), label)


def frequent_phrases(docs: DataFrame, most: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, n) of all phrases of 1 to ``most`` words that stand at least ``least`` times in their language, (lang, n) words of each language).

    Exact counts of all that are frequent enough: summaries choose what is counted, and lose nothing that reaches ``least``.
    Words are summarised without a cut.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(MOST_PARTS, 1 + size // PART_BYTES))
    keys = Keys(parts, size // parts > NARROW)
    words = _kept(rows, 1, keys, np.full(parts, np.iinfo(np.int64).max), least, None, "words")
    frequent = _filter_of(words, keys)
    masses = materialize(rows.mapInArrow(_masses(most, parts, frequent), "lang string, part int, n long").groupBy("lang", "part").agg(F.sum("n").alias("n")), "masses")
    mass = np.zeros(parts, np.int64)
    for r in masses.filter("part IS NOT NULL").collect():  # MOST_PARTS rows at most
        mass[r["part"]] = r["n"]
    kept = _kept(rows, most, keys, mass // least + 1, least, frequent, "survivors")
    packed = rows.mapInArrow(_count(most, _filter_of(words.unionByName(kept), keys)), "part int, lang string, phrases binary, counts binary")
    found = materialize(packed.repartition("part").sortWithinPartitions("part").mapInArrow(_totals(least), "lang string, words int, phrase string, n long"), "phrases")
    free(words, kept)
    return found, masses.filter("lang IS NOT NULL").select("lang", "n")


def _key(lang: Column | str, phrase: Column | str) -> Column:
    return F.concat_ws("\n", lang, phrase)


def collocations(docs: DataFrame, most: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``most`` words by ``floor(1000 * a * n / (l * r))`` of their weakest cut.

    Null texts count as empty, null languages as ``und``; repeated rows count as often as they stand; ids play no
    part. Phrases inside a longer one that stands as often are dropped: as a longer phrase stands no more often than
    its parts, it is enough to look at those of one word more. Ties go by ``a``, then by the phrase's bytes. Parts and languages that hold
    1/1000 of all words are broadcast (a few thousand rows at most), all others shuffled. No rows give no rows.
    """
    found, sizes = frequent_phrases(docs, most, least)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    phrases = found.filter("words > 1").withColumnRenamed("n", "a")
    parts = found.select(_key("lang", "phrase").alias("key"), F.col("n").alias("f"), F.col("n").alias("n_rows"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("key", _key("lang", F.expr("substring_index(phrase, ' ', k)")))
    cuts = join_counted(cuts, parts, "key", total).withColumnRenamed("f", "l").withColumn("key", _key("lang", F.expr("substring_index(phrase, ' ', k - words)")))
    cuts = join_counted(cuts, parts, "key", total).withColumnRenamed("f", "r")
    cuts = join_counted(cuts, sizes.select("lang", "n", F.col("n").alias("n_rows")), "lang", total)
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.withColumns({x + "_": exact(x) for x in "anlr"}).withColumn("score", F.expr("(a_ * n_ * 1000) div (l_ * r_)"))
    weakest = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    longer = phrases.filter("words > 2")
    inside = longer.select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"), "a").distinct()
    left = weakest.join(inside, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    cut = left.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_n") <= top)
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
