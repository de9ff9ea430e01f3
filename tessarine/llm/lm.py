"""Language-model scores from a log-frequency Bloom filter.

The filter holds every unigram and bigram of the training texts, once for each of the steps 1, 2, 3, 5, 8, 12, 18, ...
that its count reaches. A count is read back, rounded down to such a step, by probing level after level until one is missing.
Scores take every count from the filter, whatever its size; exact counts of words serve the base score alone. Segments of the
filter, by the leading bits of the keys, are built where their n-grams are counted, each as large as its own levels
need, so the filter grows with the input. Up to BROADCAST_BYTES it is broadcast. The segments of a larger one are asked
where they are built: slices of documents send their distinct n-grams with their counts, and each segment sends back, in the
same order, a byte for each with the level it holds, and exact counts of words. The scores are the same.

A token w after c has the probability (n(c, w) + K p(w)) / (n(c) + K + F): counts of pairs are rounded down, those of
contexts up, and F is the weight that pairs found by mistake have over the whole vocabulary, so that the probabilities
after a context don't sum to more than 1. Words and pairs are known by 63-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm._text import hashed_words, mix, sliced
from tessarine.llm._work import free, materialize

BROADCAST_BYTES = 1 << 27
TEXT_TO_FILTER = 8
"""For texts of more than so many times BROADCAST_BYTES no filter to broadcast is built."""
SLICE_TEXT = 1 << 24
"""Bytes of text to a slice of documents that asks the segments of a filter that isn't broadcast."""
KEY_BITS = 12
"""Bits for each level of each n-gram."""
PROBES = 8
MISTAKEN = (1 - math.exp(-PROBES / KEY_BITS)) ** PROBES
"""Share of absent keys that are found."""
SEGMENT_TEXT = 1 << 24
"""Bytes of text to a segment, up to MOST_SEGMENTS."""
LEAST_SEGMENTS, MOST_SEGMENTS = 32, 1 << 17
HOT_TOKENS = 1 << 20
"""Words with at least this part of all tokens are at most so many; their exact counts are broadcast for the base score (16 bytes each)."""
PROBED = 1 << 13
"""Keys that are probed at a time: what is held for them stays near the CPU."""
_SIFTED = {0, 1, 3, PROBES - 1}
"""Probes after which keys that are not there are left out of the next."""
RECALLED_BITS = 19
"""A worker keeps the counts of at most 2^19 keys (8 MB) from one slice of text to the next."""
GROWTH = 1.5
STEPS = [1]
"""The counts at which levels begin: each at least one and GROWTH times the one before."""
while STEPS[-1] < 2**61:
    STEPS.append(max(STEPS[-1] + 1, math.ceil(STEPS[-1] * GROWTH)))
_STEPS = np.array(STEPS)
ADD = 0.1
CONCENTRATION = 30.0
"""Least weight of the unigram distribution after any word, in tokens."""

_END = np.uint64(0x5BD1E9955BD1E995)
_UNI, _BI = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x9B05688C2B3E6C1F)
_KIND = np.uint64(1)
_COUNT_SLICE, _SCORE_SLICE = 8 << 20, 2 << 20
"""Bytes of text that a worker counts or scores at a time."""


def held_out(doc_id: int | None) -> bool:
    """Documents whose id, as text, has a CRC-32 divisible by 10; a null id counts as an empty text, which has."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts in a row, each text's words and an end, and where each text begins."""
    hashes, borders = hashed_words(texts)
    return np.insert(hashes, borders[1:], _END), borders[:-1] + np.arange(len(texts))


def unigram_keys(toks: np.ndarray) -> np.ndarray:
    return mix(toks ^ _UNI) & ~_KIND


def pair_keys(before: np.ndarray, toks: np.ndarray) -> np.ndarray:
    return mix(mix(before ^ _BI) + toks) | _KIND


def contexts(toks: np.ndarray, starts: np.ndarray | int = 0) -> np.ndarray:
    """The token before each; a text's first token follows an end."""
    before = np.concatenate([[_END], toks[:-1]])
    before[starts] = _END
    return before


def _count(segments: int):
    """For mapInArrow over (doc_id, text): keys of words and pairs and how often they occur in some documents, a row for each segment of the keys."""

    def packed(values: np.ndarray, borders: np.ndarray) -> pa.Array:
        offsets = (borders * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    def counted(some: pa.RecordBatch) -> pa.RecordBatch:
        learnt = some.filter(pa.array([not held_out(i) for i in some.column("doc_id").to_pylist()], pa.bool_()))
        keys, n = tally(_keys(learnt.column("text")))
        segment, borders = _runs(keys, segments)
        return pa.record_batch([pa.array(segment[borders[:-1]].astype(np.int32)), packed(keys, borders), packed(n.astype("<u4"), borders)], ["segment", "keys", "n"])

    return lambda batches: map(counted, sliced(batches, "text", _COUNT_SLICE))


def _keys(texts: pa.Array) -> np.ndarray:
    """The keys of all words and pairs of texts, repeats included."""
    return _token_keys(*tokens(texts))


def _token_keys(toks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    keys = np.empty(2 * len(toks), np.uint64)
    keys[: len(toks)] = unigram_keys(toks)
    keys[len(toks) :] = pair_keys(contexts(toks, starts), toks)
    return keys


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order and how often each occurs. Sorts ``keys`` itself, in its own memory."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def segments_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each key: its leading bits."""
    bits = segments.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _runs(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each of the keys, which ascend, and where each segment's begin and the last one's end."""
    segment = segments_of(keys, segments)
    return segment, np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


class Tallied:
    """Keys in ascending order and how often each occurs, of parts that are merged when they outgrow what is there."""

    def __init__(self) -> None:
        self.keys, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.fresh.append((keys, n.astype(np.int64)))
        if sum(len(k) for k, _ in self.fresh) > max(1 << 21, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        every, each = np.concatenate([self.keys, *(k for k, _ in self.fresh)]), np.concatenate([self.n, *(c for _, c in self.fresh)])
        self.fresh.clear()
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
        self.keys, self.n = every[first], np.add.reduceat(each[order], first) if len(first) else each


def level(count: np.ndarray) -> np.ndarray:
    """How many steps a count reaches: 1 for 1, 2 for 2, 3 for 3 and 4, 4 for 5 to 7, ..."""
    return np.searchsorted(_STEPS, count, "right")


def reached(levels: np.ndarray) -> np.ndarray:
    """The least count that reaches so many levels, 0 for none."""
    return np.where(levels > 0, _STEPS[levels - 1], 0).astype(np.float64)


def _places(own: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of keys for a level; probe i is at their sum with i times the second."""
    a = mix(own ^ np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
    return a, mix(a ^ _UNI) | np.uint64(1)


def _at(a: np.ndarray, b: np.ndarray, i: int, size: np.ndarray | np.uint64) -> np.ndarray:
    return (((a + np.uint64(i) * b) >> np.uint64(32)) * size) >> np.uint64(32)


class CountFilter:
    """Bits of ``segments`` segments, a power of two, of ``sizes`` bits each; a key's segment is its leading bits."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray) -> None:
        self.bits, self.sizes = bits, sizes.astype(np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Each key's count rounded down to a step, 0 for what is not there; more with probability MISTAKEN."""
        return reached(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels hold each key, up to the first that doesn't."""
        return np.concatenate([self._steps(keys[at : at + PROBED]) for at in range(0, len(keys), PROBED)] or [np.empty(0, np.int64)])

    def _steps(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), np.int64)
        segment = segments_of(keys, len(self.sizes))
        alive = np.flatnonzero(self.sizes[segment] > 0)
        keys, start, size = keys[alive], self.starts[segment[alive]], self.sizes[segment[alive]]
        step = 0
        while len(alive) and step < len(_STEPS):
            step += 1
            (at, by), of, begin, room = _places(keys, step), np.arange(len(keys)), start, size
            fine = None
            for i in range(PROBES):
                place = at >> np.uint64(32)
                place *= room
                place >>= np.uint64(32)
                place += begin
                bit = self.bits[(place >> np.uint64(3)).view(np.int64)] >> (place.astype(np.uint8) & np.uint8(7)) & np.uint8(1)
                fine = bit if fine is None else fine & bit
                if i in _SIFTED:
                    keep, fine = np.flatnonzero(fine), None
                    if len(keep) < len(of):
                        at, by, of, begin, room = at[keep], by[keep], of[keep], begin[keep], room[keep]
                at = at + by
            if len(of) < len(alive):
                alive, keys, start, size = alive[of], keys[of], start[of], size[of]
            found[alive] = step
        return found


class Recalled:
    """Counts of a filter, kept by the worker that asked: of keys that share a place, the one of the highest count stays."""

    def __init__(self, filter_: CountFilter) -> None:
        self.filter, self.keys, self.found = filter_, None, None

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """``CountFilter.counts`` of distinct keys in ascending order."""
        if self.keys is None:
            self.keys, self.found = np.zeros(1 << RECALLED_BITS, np.uint64), np.full(1 << RECALLED_BITS, -1.0)
        at = (keys >> np.uint64(64 - RECALLED_BITS)).astype(np.int64)
        known = self.found[at]
        new = np.flatnonzero((self.keys[at] != keys) | (known < 0))
        known[new] = self.filter.counts(keys[new])
        new = new[known[new] > self.found[at[new]]]
        new = new[np.lexsort((known[new], at[new]))]
        new = new[np.diff(at[new], append=-1) != 0]
        self.keys[at[new]], self.found[at[new]] = keys[new], known[new]
        return known


def segment_bits(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits of a segment with these keys and counts."""
    levels = level(n)
    size = np.uint64(8 * -(-int(levels.sum()) * KEY_BITS // 8))
    bits = np.zeros(int(size) // 8, np.uint8)
    for step in range(1, int(levels.max(initial=0)) + 1):
        a, b = _places(keys[levels >= step], step)
        for i in range(PROBES):
            at = _at(a, b, i, size)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bits


def _build(segments: int):
    """For mapInArrow over (segment, keys, n) dealt by segment: the bits of each segment, and the words with their counts."""
    names = ["segment", "bits", "key", "n"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallied = Tallied()
        for batch in batches:
            keys, n = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("n", "<u4")))
            tallied.add(keys, n)
        tallied.merge()
        keys, n = tallied.keys, tallied.n
        segment, borders = _runs(keys, segments)
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            if a < b:
                bits = segment_bits(keys[a:b], n[a:b]).tobytes()
                yield pa.record_batch([pa.array([int(segment[a])], pa.int32()), pa.array([bits], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)
        single = keys & _KIND == 0
        for at in range(0, int(single.sum()), 1 << 16):
            k, c = keys[single][at : at + (1 << 16)], n[single][at : at + (1 << 16)]
            yield pa.record_batch([pa.nulls(len(k), pa.int32()), pa.nulls(len(k), pa.binary()), pa.array(k.view(np.int64)), pa.array(c)], names)

    return build


def count_ngrams(counted: DataFrame, segments: int) -> DataFrame:
    """(segment, bits) of the filter, and (key, n) of words, of partial counts: one shuffle, written to the shared folder."""
    dealt = counted.repartitionById(segments, F.col("segment"))
    return materialize(dealt.mapInArrow(_build(segments), "segment int, bits binary, key long, n long"), "ngrams")


def n_segments(text_bytes: int) -> int:
    return min(MOST_SEGMENTS, max(LEAST_SEGMENTS, 1 << max(0, (text_bytes // SEGMENT_TEXT)).bit_length()))


def gather_filter(kept: DataFrame, segments: int) -> CountFilter:
    """The filter on the driver, for filters of up to BROADCAST_BYTES."""
    sizes = np.zeros(segments, np.int64)
    for r in kept.select("segment", F.octet_length("bits").alias("n")).collect():
        sizes[r.segment] = r.n
    bits, starts = np.empty(sizes.sum(), np.uint8), np.cumsum(sizes) - sizes
    for r in kept.toLocalIterator():
        bits[starts[r.segment] : starts[r.segment] + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return CountFilter(bits, 8 * sizes)


class Smoothing:
    """The probabilities of tokens from counts."""

    def __init__(self, n_train: int, n_types: int) -> None:
        self.over = (n_train + ADD * (n_types + 1)) * (1 + MISTAKEN)
        mistaken = MISTAKEN * n_types
        self.mistaken = mistaken + 4 * math.sqrt(mistaken)
        self.weight = CONCENTRATION + self.mistaken

    def log_p(self, pair: np.ndarray, before: np.ndarray, single: np.ndarray) -> np.ndarray:
        """log10 p of a word after another: counts of the pair and of the word, at most the true ones, and of the word before, at least the true one."""
        pair = np.minimum(pair, np.minimum(before, single))
        return np.log10((pair + self.weight * (single + ADD) / self.over) / (before + self.weight + self.mistaken))


def at_most(count: np.ndarray) -> np.ndarray:
    """The largest count that is rounded down to this one."""
    return np.where(count > 0, _STEPS[np.minimum(level(count), len(_STEPS) - 1)] - 1, 0).astype(np.float64)


def _hot_counts(hot: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are frequent, and their counts."""
    hot_keys, hot_n = hot
    if not len(hot_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    place = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
    return hot_keys[place] == keys, hot_n[place]


def model_scores(counts, smoothing: Smoothing, toks: np.ndarray, starts: np.ndarray, types: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's score of each text, and the counts of ``types``, the distinct tokens: ``counts`` gives those of distinct keys in ascending order."""
    keys = unigram_keys(types)
    order = np.argsort(keys)
    low = np.empty(len(keys))
    low[order] = counts(keys[order])
    high = at_most(low)
    before = np.concatenate([[0], back[:-1]])
    before[starts] = np.searchsorted(types, _END)
    pairs, of_pair = np.unique(pair_keys(types[before], toks), return_inverse=True)
    pair = counts(pairs)[of_pair]
    return np.add.reduceat(smoothing.log_p(pair, high[before], low[back]), starts), low


def _score(shared, hot, smoothing: Smoothing, base_over: float):
    """For mapInArrow over (doc_id, text): a row ``head`` for each text, with the base score of frequent tokens and the
    model's score, and one for each other token that the filter knows, to look up."""

    def scored(some: pa.RecordBatch, row: int) -> pa.RecordBatch:
        ids = some.column("doc_id").to_pylist()
        toks, starts = tokens(some.column("text"))
        ends = np.append(starts[1:], len(toks))
        types, back = np.unique(toks, return_inverse=True)
        keys = unigram_keys(types)
        is_hot, hot_n = _hot_counts(hot.value, keys)
        base = np.add.reduceat(np.where(is_hot, np.log10((hot_n + ADD) / base_over), 0.0)[back], starts)
        known = np.add.reduceat(is_hot.astype(np.int64)[back], starts)
        scores, low = model_scores(shared.value.counts, smoothing, toks, starts, types, back)
        rare = np.flatnonzero((~is_hot & (low > 0))[back])
        n, more = len(ids), len(rare)
        rows = np.concatenate([np.arange(row, row + n), row + np.searchsorted(ends, rare, "right")])
        return pa.record_batch(
            [pa.array(rows), pa.array(np.concatenate([mix(np.arange(row, row + n).astype(np.uint64)), keys[back[rare]]]).view(np.int64)), pa.array(np.arange(n + more) < n),
             *(pa.concat_arrays([x, pa.nulls(more, x.type)]) for x in (pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array((ends - starts).astype(np.int64)), pa.array(known), pa.array(base), pa.array(scores)))],
            ["row", "key", "head", "doc_id", "held_out", "n_tokens", "hot_known", "hot_score", "score"],
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40

        def numbered(some: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row
            row += len(some)
            return scored(some, row - len(some))

        return map(numbered, sliced(batches, "text", _SCORE_SLICE))

    return score


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: values that are near each other are stored in few bytes."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def of_planes(raw: bytes) -> np.ndarray:
    """The 64-bit values of ``planes``."""
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _ask(segments: int):
    """For mapInArrow over (slice, doc_id, text) of one slice: its distinct keys and how often they occur in documents that are learnt from, a row for each segment."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallied, own = Tallied(), None
        for some in sliced(batches, "text", _SCORE_SLICE):
            own = some.column("slice")[0].as_py()
            learnt = np.array([not held_out(i) for i in some.column("doc_id").to_pylist()])
            for part, times in ((learnt, 1), (~learnt, 0)):
                keys, n = tally(_keys(some.filter(pa.array(part)).column("text")))
                tallied.add(keys, n * times)
        tallied.merge()
        segment, borders = _runs(tallied.keys, segments)
        runs = list(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True))
        if runs:
            packed = [pa.array([planes(x[a:b]) for a, b in runs], pa.binary()) for x in (tallied.keys, tallied.n)]
            yield pa.record_batch([pa.array(segment[borders[:-1]].astype(np.int32)), pa.array([own] * len(runs), pa.int32()), *packed], ["segment", "slice", "keys", "n"])

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over all that slices ask of one segment: it is built, and each slice gets the levels of its keys and the exact
    counts of its words, in the order of the keys. One row has how many tokens and words the segment learnt."""
    who, keys, n, own = [], [], [], None
    for batch in batches:
        for name, into in (("keys", keys), ("n", n)):
            into += map(of_planes, batch.column(name).to_pylist())
        who += batch.column("slice").to_pylist()
        own = batch.column("segment")[0].as_py() if len(batch) else own
    if not who:
        return
    upto = np.cumsum([0, *map(len, keys)])
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    keys.clear()
    counts = np.bincount(back, np.concatenate(n)).astype(np.int64)
    n.clear()
    bits = segment_bits(every, counts)
    levels, word = CountFilter(bits, np.array([8 * len(bits)])).levels(every).astype(np.uint8), every & _KIND == 0
    totals = [[int(x)] + [0] * (len(who) - 1) for x in (counts[word].sum(), np.count_nonzero(counts[word]))]
    runs = [back[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]
    packed = [[levels[r].tobytes() for r in runs], [planes(counts[r[word[r]]]) for r in runs]]
    yield pa.record_batch(
        [pa.array(who, pa.int32()), pa.array([own] * len(who), pa.int32()), *(pa.array(x, pa.binary()) for x in packed), *(pa.array(x, pa.int64()) for x in totals)],
        ["slice", "segment", "levels", "words", "tokens", "types"],
    )


def _score_slice(smoothing: Smoothing, over: float, n_train: int):
    """For mapInArrow over one slice, its answers first, by segment: the rows of ``score_documents``. Equal documents are scored once."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, words, held = [], [], None
        for batch in batches:
            levels += [np.frombuffer(x, np.uint8) for x in batch.column("levels").drop_null().to_pylist()]
            words += map(of_planes, batch.column("words").drop_null().to_pylist())
            docs = pa.table(batch.filter(batch.column("segment").is_null()).select(["doc_id", "text"]))
            docs = docs.append_column("times", pa.array(np.ones(len(docs), np.int64)))
            held = (pa.concat_tables([held, docs]) if held else docs).group_by(["doc_id", "text"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc_id", "text", "times"])
        if not held:
            return
        pieces = [(x, *tokens(x.column("text"))) for x in sliced(iter(held.combine_chunks().to_batches()), "text", _SCORE_SLICE)]
        every = tally(np.concatenate([tally(_token_keys(toks, starts))[0] for _, toks, starts in pieces]))[0]
        levels, words = np.concatenate(levels).astype(np.int64), np.concatenate(words).astype(np.float64)
        of_word = np.cumsum(every & _KIND == 0) - 1
        if len(levels) != len(every) or len(words) != of_word[-1] + 1:
            raise RuntimeError("the documents of a slice are not those that asked: they have to be the same ones at each reading")
        for x, toks, starts in pieces:
            types, back = np.unique(toks, return_inverse=True)
            scores, _ = model_scores(lambda keys: reached(levels[np.searchsorted(every, keys)]), smoothing, toks, starts, types, back)
            n = words[of_word[np.searchsorted(every, unigram_keys(types))]]
            base = np.add.reduceat(np.log10((n + ADD) / over)[back], starts)
            known = np.add.reduceat((n > 0).astype(np.int64)[back], starts)
            ids, many = x.column("doc_id"), len(x)
            rows = pa.record_batch([ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), *map(pa.array, (np.diff(starts, append=len(toks)), known, np.full(many, n_train), base, scores))], names)
            yield rows.take(pa.array(np.repeat(np.arange(many), x.column("times").to_numpy())))

    return score


def score_by_segments(source: DataFrame, segments: int, slices: int) -> DataFrame:
    """``score_documents`` where the filter is too large to broadcast. A document's slice is a hash of it, the same at each reading."""
    dealt = source.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int").alias("slice"), "doc_id", "text")
    asked = dealt.repartitionById(slices, F.col("slice")).mapInArrow(_ask(segments), "segment int, slice int, keys binary, n binary")
    answer = asked.repartitionById(segments, F.col("segment")).mapInArrow(_answer, "slice int, segment int, levels binary, words binary, tokens long, types long")
    answers = materialize(answer, "answers")
    n_train, n_types = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    met = dealt.unionByName(answers.drop("tokens", "types"), allowMissingColumns=True).repartitionById(slices, F.col("slice")).sortWithinPartitions(F.col("segment").asc_nulls_last())
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met.mapInArrow(_score_slice(Smoothing(n_train, n_types), n_train + ADD * (n_types + 1), n_train), kind)


def score_by_broadcast(source: DataFrame, counted: DataFrame, segments: int) -> DataFrame:
    """``score_documents`` with a filter that every task holds."""
    spark = source.sparkSession
    kept, singles = counted.filter("bits is not null").select("segment", "bits"), counted.filter("key is not null").select("key", "n")
    n_train, n_types = singles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    floor = max(1, -(-n_train // HOT_TOKENS))
    hot = singles.filter(F.col("n") >= floor).toPandas()
    hot_keys = hot["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_keys)
    frequent = spark.sparkContext.broadcast((hot_keys[order], hot["n"].to_numpy(np.float64)[order]))
    over, smoothing = n_train + ADD * (n_types + 1), Smoothing(n_train, n_types)
    shared = spark.sparkContext.broadcast(Recalled(gather_filter(kept, segments)))
    kind = "row long, key long, head boolean, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_score double, score double"
    scored = source.mapInArrow(_score(shared, frequent, smoothing, over), kind)
    joined, once = scored.join(singles.filter(F.col("n") < floor), "key", "left"), F.col("head")
    n = F.when(~once, F.col("n"))
    heads = {c: F.max(F.when(once, F.col(c))).alias(c) for c in ("doc_id", "held_out", "n_tokens", "hot_known", "hot_score", "score")}
    summed = joined.groupBy("row").agg(*heads.values(), F.count(n).alias("more"), F.coalesce(F.sum(F.log10((n + ADD) / over)), F.lit(0.0)).alias("cold_score"))
    known = F.col("hot_known") + F.col("more")
    base = F.col("hot_score") + F.col("cold_score") + (F.col("n_tokens") - known) * math.log10(ADD / over)
    return summed.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Learns from rows that are not held out. A null or empty text is one end token. A null doc_id is held out. Repeated
    rows count, and are scored, each for itself. Without training rows all counts are 0 and every token has the base
    probability 0.1 / (0.1 * 1). No rows give no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learns = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0
    taught, size = source.filter(learns), F.octet_length("text").cast("long")
    learnt, whole = source.agg(F.coalesce(F.sum(F.when(learns, size)), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    segments = n_segments(learnt)
    if learnt <= TEXT_TO_FILTER * BROADCAST_BYTES:
        counted = count_ngrams(taught.mapInArrow(_count(segments), "segment int, keys binary, n binary"), segments)
        if (counted.agg(F.sum(F.octet_length("bits").cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
            return score_by_broadcast(source, counted, segments)
        free(counted)
    return score_by_segments(source, segments, max(LEAST_SEGMENTS, -(-whole // SLICE_TEXT)))
