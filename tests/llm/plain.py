"""Plain versions of operators, one document at a time, as the tests' brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

from tessarine.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]


def shingle_set(text):
    w = lowered(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked_components(docs):
    """{doc_id: (set size, smallest doc_id reachable)}, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i in sets:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    shared = Counter((a, b) for own in holders.values() for k, a in enumerate(sorted(own)) for b in sorted(own)[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def chunks(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, words): a chunk ends before the next word where the hash of the last 16 bytes of a word is small, or it is full."""
    found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out, start, n, h, at = [], 0, 0, 0, 0
    for k, (_, end) in enumerate(found):
        for b in raw[at:end]:
            h = (2 * h + int(substring._GEAR[b])) % 2**16
        at, n = end, n + 1
        if k + 1 < len(found) and (h < 2**16 // substring.MEAN_WORDS or n == substring.MAX_WORDS):
            out.append((start, found[k + 1][0], n))
            start, n = found[k + 1][0], 0
    return [*out, (start, len(raw), n)] if raw else []


def windows(raw: bytes) -> list[tuple[int, int, tuple]]:
    """(first chunk, end chunk, contents) of the shortest runs of MIN_WORDS words or more from each chunk and to each chunk."""
    own = chunks(raw)
    n = [c[2] for c in own]
    spans = set()
    for i in range(len(own)):
        spans |= {(i, j) for j in range(i + 1, len(own) + 1) if sum(n[i:j]) >= substring.MIN_WORDS and sum(n[i : j - 1]) < substring.MIN_WORDS}
        spans |= {(k, i + 1) for k in range(i + 1) if sum(n[k : i + 1]) >= substring.MIN_WORDS and sum(n[k + 1 : i + 1]) < substring.MIN_WORDS}
    return [(i, j, tuple(raw[a:b].rstrip() for a, b, _ in own[i:j])) for i, j in sorted(spans)]


def without_repeats(docs):
    """{doc_id: text} without windows that a smaller id has, or that stood before in the same text."""
    found = {i: windows((t or "").encode()) for i, t in docs}
    owner = {}
    for i in sorted(found):
        for *_, what in found[i]:
            owner.setdefault(what, i)
    out = {}
    for i, text in docs:
        raw, seen, gone = (text or "").encode(), set(), np.zeros(len((text or "").encode()), bool)
        own = chunks(raw)
        for a, b, what in found[i]:
            if owner[what] != i or what in seen:
                gone[own[a][0] : own[b - 1][1]] = True
            seen.add(what)
        out[i] = text if text is None else bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode()
    return out


def mixed(rows):
    """How often each (doc_id, text, source) is taken."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    taken = {}
    for s in names:
        rounds = int(target[s] // sizes[s]) if sizes[s] else 0
        budget, upto, ended = target[s] - rounds * sizes[s], 0, False
        for i, text, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"{r[0]}:{r[1] or ''}".encode()).hexdigest()[:10]):
            upto += len(words(text))
            ended |= upto > budget
            taken[i] = (rounds + (rounds < 2 and not ended)) if words(text) else 1
    return taken


def pieces(text, tokenizer, length=2048):
    """(start, length, crc) of a document's pieces."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    own = [(at, np.asarray(ids[at : at + length], "<u4")) for at in range(0, len(ids), length)]
    return [(at, len(x), zlib.crc32(x.tobytes())) for at, x in own]
