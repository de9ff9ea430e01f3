"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm._text import slices
from tessarine.llm._work import materialize

LENGTH = 2048
GROUP_PIECES = 200_000
CACHE_WORDS = 400_000
END_ID = 0
PUNCTUATION = ".,!*$#%&;:?"
SLICE_BYTES = 16 << 20

_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+").fullmatch
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _ends_in_letter(word: str) -> bool:
    """Also after composing and lower-casing, which may leave a mark at the end."""
    last = word[-1]
    return last.isalpha() if last.isascii() else unicodedata.normalize("NFC", last).lower()[-1].isalpha()


class WordIds:
    """Token ids of words, for tokenizers that lower-case and drop white space: a text's ids are its words' ids in a row.

    A word's trailing punctuation is a token piece of its own after a letter, so ``stem`` and ``stem,`` share a lookup.
    Two generations of at most CACHE_WORDS words are kept; words in use move to the younger one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) if suffix else 0, bool)
        for token, id_ in self.tokenizer.get_vocab().items() if suffix else ():
            self.ends_word[id_] = token.endswith(suffix)
        self.old: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {"": b""}

    def encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each of some distinct words with its ids. Words of Latin letters alone end in just one end-of-word token, so many go as one text."""
        plain = [w for w in words if _LETTERS(w)] if len(self.ends_word) else []
        for at in range(0, len(plain), 1 << 16):
            texts = [plain[k : k + 1024] for k in range(at, min(len(plain), at + (1 << 16)), 1024)]
            for some, e in zip(texts, self.tokenizer.encode_batch_fast([" ".join(x) for x in texts], add_special_tokens=False), strict=True):
                ids = np.asarray(e.ids, "<u4")
                raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
                yield from ((w, raw[a:b]) for w, a, b in zip(some, [0, *ends[:-1]], ends, strict=True))
        rest = [w for w in words if not _LETTERS(w)] if plain else words
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            yield from ((w, np.asarray(e.ids, "<u4").tobytes()) for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True))

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words, as little-endian 32-bit numbers."""
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {"": b""}
        table, todo, parts = self.new, {}, {}
        for w in words:
            if w in table:
                continue
            if (found := self.old.get(w)) is not None:
                table[w] = found
                continue
            stem = w.rstrip(PUNCTUATION)
            if stem and len(stem) < len(w) and _ends_in_letter(stem):
                parts[w] = stem, w[len(stem) :]
                todo |= {x: None for x in parts[w] if x not in table}
            else:
                todo[w] = None
        table.update(self.encode(list(todo)))
        for w, (stem, tail) in parts.items():
            table[w] = table[stem] + table[tail]
        return [table[w] for w in words]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last one's end."""
        whole = pc.fill_null(texts, "")
        # special tokens are case-sensitive, so texts that may hold one keep their case; the tokenizer lower-cases the others alike
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_lower(whole)))
        words = split.flatten().dictionary_encode()
        found = self.learn(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        place = words.indices.to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes[place])])
        out = flat[np.repeat(starts[place] - upto[:-1], sizes[place]) + np.arange(upto[-1])]
        return out, upto[np.cumsum(np.concatenate([[0], pc.list_value_length(split).to_numpy(zero_copy_only=False)]))]


_known: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """One table per Python worker, for all its tasks."""
    if path not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _known.clear()
        _known[path] = WordIds(path)
    return _known[path]


def cut_documents(path: str, length: int = LENGTH):
    """A function for mapInArrow: (doc_id, text) -> a row for each piece of at most ``length`` ids, numbered through."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(path)
        end = np.uint32(END_ID).astype("<u4").tobytes()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                ids, pieces, starts, lengths, sums = [], [], [], [], []
                flat, borders = known.ids(some.column("text"))
                for doc_id, a, b in zip(some.column("doc_id").to_pylist(), borders[:-1], borders[1:], strict=True):
                    raw = flat[a:b].tobytes() + end
                    for piece, at in enumerate(range(0, len(raw), 4 * length)):
                        own = raw[at : at + 4 * length]
                        ids.append(doc_id), pieces.append(piece), starts.append(at // 4), lengths.append(len(own) // 4), sums.append(zlib.crc32(own))
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                    ["row", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
                row += len(ids)

    return cut


class TightestBins:
    """Open bins by remaining room, under a segment tree over rooms 0..size.

    A leaf says whether a bin with exactly that room is open; ``least(room)`` descends to the smallest open room that
    is enough, in logarithmic time.
    """

    def __init__(self, size: int) -> None:
        self.size = 1 << size.bit_length()
        self.any = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.open[room].append(bin_)
        at = room + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def least(self, room: int) -> int:
        """The smallest open room of at least ``room``, or -1."""
        any_, at = self.any, room + self.size
        if any_[at]:
            return room
        while at > 1:
            if not at & 1 and any_[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if any_[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1

    def take(self, room: int) -> int:
        bin_ = self.open[room].pop()
        at = room + self.size
        if not self.open[room]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return bin_


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths must come in decreasing order."""
    bins = TightestBins(size)
    chosen, offsets, made = [], [], 0
    for n in lengths:
        room = bins.least(n)
        if room < 0:
            bin_, room, made = made, size, made + 1
        else:
            bin_ = bins.take(room)
        chosen.append(bin_)
        offsets.append(size - room)
        bins.add(room - n, bin_)
    return chosen, offsets


def _pack_group(length: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        chosen, offsets = best_fit(table.column("length").to_pylist(), length)
        first = (table.column("part")[0].as_py() if len(table) else 0) << 32
        table = table.append_column("sequence_id", pa.array(np.asarray(chosen, np.int64) + first)).append_column("offset", pa.array(offsets, pa.int64()))
        return table.drop_columns(["part", "row"])

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``.

    A document is its text's token ids and one end id; a null or empty text is the end id alone. Only documents over
    ``length`` are cut. Pieces are dealt by hash to groups of about ``group_pieces`` and each group is packed by best
    fit decreasing; a group leaves at most a few sequences part empty. Null and repeated doc_ids are rows like others.
    Rows are dealt by their place in the table as it is read, so that a row that is repeated ever so often is spread
    too, and reruns over the same files agree. No rows give no rows.
    """
    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_documents(tokenizer, length), "row long, " + _PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(_pack_group(length), _PIECES + ", sequence_id long, offset long")
