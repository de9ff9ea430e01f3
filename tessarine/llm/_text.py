"""Words and shingles of whole texts, as hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have at most ``most`` bytes together, or of one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``slices`` of all batches; none is held here while the next is read."""
    for batch in batches:
        yield from slices(batch, column, most)
        del batch


def digests(words: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each of ``words``, none of them null."""
    if not len(words):
        return np.empty(0, np.uint64)
    borders = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    raw = memoryview(words.buffers()[2] or b"")
    return np.fromiter(map(xxhash.xxh3_64_intdigest, map(raw.__getitem__, map(slice, borders[:-1], borders[1:]))), np.uint64, len(words))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, A-Z lower-cased, and where each text's begin and the last one's end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = split.flatten().dictionary_encode()
    known = found.dictionary.cast(pa.large_binary())
    of_word = digests(known)
    place = found.indices.to_numpy(zero_copy_only=False)
    borders = np.cumsum(np.concatenate([[0], pc.list_value_length(split).to_numpy(zero_copy_only=False)]))
    nothing = known.index(b"").as_py()
    if nothing >= 0:  # what stands before a leading blank and after a trailing one
        keep = place != nothing
        borders, place = np.concatenate([[0], np.cumsum(keep)])[borders], place[keep]
    return of_word[place], borders


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; for fewer words, one for the whole sequence; none without words."""
    size = min(n, len(hashes))
    if not size:
        return np.empty(0, np.uint64)
    last = len(hashes) - size + 1
    out = np.full(last, np.uint64(size), np.uint64)
    for i in range(size):
        out = mix(out * _STEP + hashes[i : i + last])
    return out


class Cut:
    """Words of many texts in a row: ``known`` distinct ones as bytes, ``place`` which one stands there, ``row`` of which text, ``piece`` a number that changes with each break and text;
    ``starts`` and ``ends`` are bytes, those of text i from ``borders[i]`` on. A-Z are lower-cased unless ``lower`` is false."""

    def __init__(self, texts: pa.Array, blanks: bytes, breaks: bytes = b"", lower: bool = True) -> None:
        whole = pc.fill_null(texts, "").cast(pa.large_binary())
        borders = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
        raw = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
        borders = borders - borders[0]
        kinds, letters = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
        kinds[list(blanks)], kinds[list(breaks)] = 1, 2
        letters[65:91] += 32 * lower
        kind = kinds[raw]
        word = kind == 0
        opens, shuts = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        shuts[:-1] &= ~word[1:]
        inner = borders[1:-1]
        at = inner[(inner > 0) & (inner < len(raw))]
        opens[at], shuts[at - 1] = word[at], word[at - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        self.borders, self.starts, self.ends = borders, starts, ends
        self.row = np.searchsorted(borders, starts, "right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[starts] + self.row if breaks else self.row
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[raw[word]])]).dictionary_encode()
        self.known, self.place = found.dictionary, found.indices.to_numpy(zero_copy_only=False)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word in its place."""
        return digests(self.known)[self.place]
