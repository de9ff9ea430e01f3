"""Personal data in texts: patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The field labels each word with a kind or none. Its weights are trained from a small labelled table by gradient ascent on the
conditional likelihood. Whole texts are decoded by Viterbi in numpy batches. A word has no kind where even the best run of words
around it, each with its best kind, can't outweigh no kind; this is exact, and leaves short runs of words to search.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm._text import Cut, slices

KINDS = ("email", "ip", "card", "phone")
"""The order of kinds at one start."""
LABELS = ("", *KINDS)
SLICE_BYTES = 4 << 20
FEATURES = 1 << 12
MAX_LABELLED = 2000
"""A labelled table may have at most so many rows: the model is trained on the driver."""
KNOWN_WORDS = 50_000
PUNCTUATION = ".,;:!?()[]{}<>\"'*&%$#|="
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

# The patterns. The possessive forms and the look-behind find the same matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Sentences of the labelled table; what stands in braces is filled. Names are no kind. The others hold no kind at all.
SENTENCES = (
    "Please call {phone} after six.", "You can reach me at {phone} or {phone}.", "Phone: {phone}", "tel. {phone}", "Tel: {phone}, ask for {name}.", "My number is {phone} and I live here.",
    "Fax {phone} for orders.", "Text {phone} today.", "Mobile {phone} is mine.", "Send it to {email} please.", "Email: {email}", "Write to {email} or call {phone}.", "e-mail {email} for details.",
    "My address is {email} since May.", "Contact {name} at {email} soon.", "The host {ip} was down.", "Logged in from {ip} at noon.", "IP: {ip}", "Server address {ip} answered.", "Card number {card} was charged.",
    "Pay with {card} now.", "Visa {card} expires soon.", "credit card: {card}", "My name is {name} and I work here.", "Dear Mr. {name}, thank you.", "Mrs. {name} came late.", "Signed by Dr. {name} yesterday.",
    "I am called {name} by friends.", "Patient name: {name}", "Name: {name}, phone: {phone}", "Ms. {name} said so.",
)
PLAIN = (
    "The price is 19.99 today.", "It was 12.50 or 1,250.00 in all.", "In 1999 and 2024 it rained.", "On 2024-05-17 the work began.", "Version 3 of the licence, 4.0 or later.", "Licensed under CC BY-NC 4.0.",
    "See page 12 and chapter 3.", "token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\"", "The id 9807915762804490 was given.", "Order 4845168114407329 came late.", "About 100% of all, some 50 or 60.", "It cost $15 and $20 | $30.",
    "The man and the woman went home.", "A house stands by the River Thames in London.", "Thing and That. The end of it.", "Then he said: no, this is all.", "We met at ten and at noon.", "Look at the dot on the page.",
    "LOOK AT THIS NOW!! ALL OF IT!!", "He came and saw the town of Lyon.", "Section 1.2.3 says more.", "From 10:30 to 11:45 we wait.", "I am happy and she is tired.", "The name of the town is old.", "This number is large.",
    "Der Hund und die Katze gehen nach Hause.", "El perro y la casa de la madre.", "Le chat et la maison de la ville.", "Call it a day.", "My address is here.", "The card was lost.", "A phone rang.", "Write to them or send it.", "Please text today.",
    "Thursday. The street was wet, and. Nothing came.", "words### more*** and%%% then$$$ others&&& go", "1 2 3 4 5 6 7 8", "rows | of | a | table | with | 12 | cells", "Dear friends, thank you.", "The server answered. The host was kind.", "It is at home dot and at work.",
    "no 555 is here, 42 are there", "build 20240517 passed", "sizes 10-20 and 30-40 fit", "ISBN 978-3-16-148410-0 is a book.", "rate 3.5 of 5.0 (12 votes)", "for (i = 0; i < 10; i++)", "Item #4412 is gone.", "He is 42 years old (born 1982).", "sum 1 000 000 in all", "The total 12 345 678 901 is large.", "some 4 500 200 100 cells and 20 300 400 500 more",
)
FIRST = "Anna Ben Clara David Emma Felix Greta Hugo Ines Jonas Karen Leon Maria Noah Olga Paul Rosa Simon Tina Victor".split()
LAST = "Adams Bauer Costa Dupont Evans Fischer Garcia Hansen Ivanov Jensen Keller Lopez Martin Nowak Olsen Perez Rossi Schmidt Turner Weber".split()
SOUNDS = "ba ko mi tre ou la ne schu ver ge zu ci que do ja re th an on er in st nd ea".split()
COMMON = "the of and to a in is it was for on are der die und zu von im el los que en una le la et les des".split()
ROUNDS, INVENTED = 12, 240


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][0::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run before an ``@`` and after the last match; it can't reach over another ``@``."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, in code points, by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _filler(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name, last = r.choice(FIRST), r.choice(LAST)
    if kind == "phone":
        return r.choice([f"+1 ({d(3)}) 555-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(7)}", f"0{d(2)} {d(3)} {d(4)}", f"+49 {d(3)} {d(6)}"])
    if kind == "email":
        who, host, end = name.lower(), last.lower(), r.choice(["com", "org", "net"])
        return r.choice([f"{who}.{d(2)}@{host}.{end}", f"{who} [at] {host} [dot] {end}", f"{who}(at){host}.{end}", f"{who}[at]{host}[dot]{end}", f"{who} (at) {host} (dot) {end}", f"{who}_{d(2)}@{host}.{end}", f"{who} [at] {host}.{end}"])
    if kind == "ip":
        return ".".join(str(r.randrange(1, 255)) for _ in range(4))
    if kind == "card":
        own = "4" + d(14)
        own += next(c for c in "0123456789" if luhn(own + c))
        cut = [own[i : i + 4] for i in range(0, 16, 4)]
        return r.choice([own, " ".join(cut), "-".join(cut), ".".join(cut)])
    return r.choice([f"{name} {last}", name, f"{name} {r.choice('ABCDEFGH')}. {last}", last])


def labelled_table(seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans): every sentence ROUNDS times with other fillers, and the plain ones, so that a kind's words are learnt as shapes."""
    r, out = random.Random(seed), []
    for _ in range(ROUNDS):
        for sentence in SENTENCES:
            text, spans = "", []
            for part in re.split(r"(\{[a-z]+\})", sentence):
                if part.startswith("{"):
                    kind, part = part[1:-1], _filler(part[1:-1], r)
                    spans += [(kind, len(text), len(text) + len(part))] if kind in KINDS else []
                text += part
            out.append((text, spans))
    return out + [(p, []) for p in PLAIN for _ in range(3)] + [(_invented(r), []) for _ in range(INVENTED)]


def _invented(r: random.Random) -> str:
    """Some sentences of words that no other row has, with a few common ones between: capitals alone are no name."""
    text = []
    for _ in range(r.randrange(1, 4)):
        own = [r.choice(COMMON) if r.random() < 0.4 else "".join(r.choice(SOUNDS) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 9))]
        own = [w.capitalize() if r.random() < 0.15 or not i else w for i, w in enumerate(own)]
        own = [w + "," if r.random() < 0.1 else w for w in own]
        text.append(" ".join(own).rstrip(",") + r.choice([".", ".", ".", "!", "?", ":", ""]))
    whole = " ".join(text)
    return whole.upper() if r.random() < 0.1 else whole


def signature(word: str, known: frozenset[str]) -> tuple:
    """What the field sees of a word: itself where the labelled table has it, else its shape, digits, and marks at its ends."""
    core = word.strip(PUNCTUATION)
    low = core.lower() if core.isascii() else core
    own = low if low in known else "?"
    if not _DIGIT.search(word) and "@" not in word:
        shape = "X" if core.isupper() else "Xx" if core[:1].isupper() else "x" if core[:1].isalpha() else "o"
        return own, shape, 0, "." if word[-1:] in tuple(".,;:!?") else "", ""
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c for c in core))
    return own, shape[:24], min(20, len(_DIGIT.findall(word))), "." if word[-1:] in tuple(".,;:!?") else word[-1:] if word[-1:] in tuple(")]") else "", word[0] if word[0] in "([" else ""


def features(sig: tuple) -> list[int]:
    own, shape, digits, trail, lead = sig
    each = (f"w={own}", f"s={shape}", f"d={digits}", f"sd={shape}:{digits}", f"t={trail}", f"l={lead}:{shape}", f"n={min(digits, 1)}{shape[:1]}")
    return [xxhash.xxh32_intdigest(f) % FEATURES for f in each]


class Field:
    """Weights for a word's own features and its neighbours', (3, FEATURES, labels), for label pairs, and for first and last labels."""

    def __init__(self, words: frozenset[str], own: np.ndarray, pairs: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.words, self.own, self.pairs, self.first, self.last = words, own, pairs, first, last
        self.inside = (pairs[1:, 1:] - pairs[0, 0]).max()
        self.border = max((pairs[0, 1:] - pairs[0, 0]).max(), (first[1:] - first[0]).max()) + max((pairs[1:, 0] - pairs[0, 0]).max(), (last[1:] - last[0]).max()) - self.inside
        """What the label pairs of a run of kinds can add to its words' scores: ``border`` once and ``inside`` for each word."""
        vocabulary = ["?", *sorted(words)]
        self.vocabulary = pa.array(vocabulary[1:], pa.string())
        self.plain = np.stack([self.row((w, s, 0, t, "")) for w in vocabulary for s in ("X", "Xx", "x", "o") for t in ("", ".")])
        self.seen: dict[str, np.ndarray] = {}

    def row(self, sig: tuple) -> np.ndarray:
        """(3, labels): what a word adds to its own place, the one after it and the one before it."""
        return self.own[:, features(sig)].sum(axis=1)

    def rows(self, known: pa.Array) -> np.ndarray:
        """(words, 3, labels). Words without digits and ``@`` go by kernels, others one by one and are remembered."""
        if not len(known):
            return np.zeros((0, 3, len(LABELS)))
        core = pc.utf8_trim(known, PUNCTUATION)
        low = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core)
        own = pc.fill_null(pc.index_in(low, self.vocabulary), -1).to_numpy(zero_copy_only=False) + 1
        is_ = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
        shape = np.where(is_(pc.utf8_is_upper(core)), 0, np.where(is_(pc.match_substring_regex(core, r"^\p{Lu}")), 1, np.where(is_(pc.match_substring_regex(core, r"^\p{L}")), 2, 3)))
        out = self.plain[own * 8 + shape * 2 + is_(pc.match_substring_regex(known, "[.,;:!?]$"))]
        odd = np.flatnonzero(is_(pc.match_substring_regex(known, "[0-9@]")))
        if len(self.seen) > KNOWN_WORDS:
            self.seen.clear()
        for i, word in zip(odd, known.take(pa.array(odd)).to_pylist(), strict=True):
            if (found := self.seen.get(word)) is None:
                found = self.row(signature(word, self.words))
                if len(word) < 64:
                    self.seen[word] = found
            out[i] = found
        return out

    def scores(self, cut: Cut) -> np.ndarray:
        """(words, labels) of a cut of texts, neighbours within the text."""
        rows = self.rows(cut.known.cast(pa.large_string()).cast(pa.string()))[cut.place]
        out = rows[:, 0].copy()
        near = (cut.row[1:] == cut.row[:-1])[:, None]
        out[1:] += rows[:-1, 1] * near
        out[:-1] += rows[1:, 2] * near
        return out

    def decode(self, cut: Cut) -> np.ndarray:
        """The best labels of each text's words together."""
        scores = self.scores(cut)
        labels = np.zeros(len(scores), np.int8)
        if not len(scores):
            return labels
        upto = np.cumsum(scores[:, 1:].max(axis=1) - scores[:, 0] + self.inside)
        most = np.maximum.accumulate(upto[::-1])[::-1] - np.minimum.accumulate(np.concatenate([[0.0], upto[:-1]]))
        unsure = np.flatnonzero(most + self.border >= -1e-6)  # else no run over this word is worth more than no kind
        if not len(unsure):
            return labels
        cuts = np.flatnonzero((np.diff(unsure) > 1) | (np.diff(cut.row[unsure]) > 0)) + 1
        begin, stop = unsure[np.concatenate([[0], cuts])], unsure[np.concatenate([cuts, [len(unsure)]]) - 1] + 1
        opens, shuts = begin == np.searchsorted(cut.row, cut.row[begin]), stop == np.searchsorted(cut.row, cut.row[begin], "right")
        for n in np.unique(stop - begin):
            of = stop - begin == n
            at = begin[of][:, None] + np.arange(n)
            labels[at] = self.viterbi(scores[at], opens[of], shuts[of])
        return labels

    def viterbi(self, scores: np.ndarray, opens: np.ndarray, shuts: np.ndarray) -> np.ndarray:
        """(runs, words, labels) to labels; a run's neighbours have no kind, where it doesn't begin or end its text."""
        best = scores[:, 0] + np.where(opens[:, None], self.first, self.pairs[0])
        back = np.empty(scores.shape, np.int8)
        for t in range(1, scores.shape[1]):
            each = best[:, :, None] + self.pairs
            back[:, t] = each.argmax(axis=1)
            best = each.max(axis=1) + scores[:, t]
        at = (best + np.where(shuts[:, None], self.last, self.pairs[:, 0])).argmax(axis=1)
        out, runs = np.empty(scores.shape[:2], np.int8), np.arange(len(scores))
        for t in range(scores.shape[1] - 1, -1, -1):
            out[:, t] = at
            if t:
                at = back[runs, t, at]
        return out


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def train(table: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 100, rate: float = 0.2, decay: float = 2e-4) -> Field:
    """The field that makes the labelled table likely: Adam on the conditional log-likelihood less ``decay`` times the squared weights."""
    if len(table) > MAX_LABELLED:
        raise ValueError(f"a labelled table has at most {MAX_LABELLED} rows")
    table = [(t, s) for t, s in table if _words(t or "")]
    count: dict[str, int] = {}
    for text, _ in table:
        for w in {w.strip(PUNCTUATION).lower() for w, _, _ in _words(text)}:
            count[w] = count.get(w, 0) + 1
    words = frozenset(w for w, n in count.items() if w and n > 2 and not _DIGIT.search(w) and w.isascii() and w not in {x.lower() for x in (*FIRST, *LAST)})
    k, most = len(LABELS), max((len(_words(t)) for t, _ in table), default=1)
    ids = np.full((len(table), most + 2, 7), FEATURES)  # a place before and after each text, of a feature without weight
    gold, there = np.zeros((len(table), most), np.int64), np.zeros((len(table), most), bool)
    for i, (text, spans) in enumerate(table):
        for t, (w, a, b) in enumerate(_words(text)):
            ids[i, t + 1] = features(signature(w, words))
            there[i, t] = True
            gold[i, t] = next((LABELS.index(kind) for kind, x, y in spans if x < b and a < y), 0)
    near = np.stack([ids[:, 1:-1], ids[:, :-2], ids[:, 2:]])
    n, rows = there.sum(axis=1), np.arange(len(table))
    own, pairs, ends = np.zeros((3, FEATURES + 1, k)), np.zeros((k, k)), np.zeros((2, k))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (own, pairs, ends)]
    one = np.eye(k)
    for step in range(1, steps + 1):
        s = sum(own[j][near[j]].sum(axis=2) for j in range(3))
        alpha, beta = np.empty_like(s), np.empty_like(s)
        alpha[:, 0] = ends[0] + s[:, 0]
        for t in range(1, most):
            alpha[:, t] = np.where(there[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + pairs, axis=1) + s[:, t], alpha[:, t - 1])
        beta[:, most - 1] = ends[1]
        for t in range(most - 2, -1, -1):
            beta[:, t] = np.where(there[:, t + 1, None], np.logaddexp.reduce(pairs + (s[:, t + 1] + beta[:, t + 1])[:, None], axis=2), ends[1])
        z = np.logaddexp.reduce(alpha[:, most - 1] + ends[1], axis=1)
        wrong = (one[gold] - np.exp(alpha + beta - z[:, None, None])) * there[:, :, None]
        g_own = np.zeros_like(own)
        each = np.repeat(wrong.reshape(-1, k), 7, axis=0)
        for j in range(3):
            for label in range(k):
                g_own[j, :, label] = np.bincount(near[j].reshape(-1), each[:, label], FEATURES + 1)
        g_own[:, FEATURES] = 0
        both = np.exp(alpha[:, :-1, :, None] + pairs + (s[:, 1:] + beta[:, 1:])[:, :, None] - z[:, None, None, None]) * there[:, 1:, None, None]
        g_pairs = np.einsum("itj,itk->jk", one[gold[:, :-1]] * there[:, 1:, None], one[gold[:, 1:]]) - both.sum(axis=(0, 1))
        g_ends = np.stack([wrong[:, 0].sum(axis=0), wrong[rows, n - 1].sum(axis=0)])
        for x, g, (m, v) in zip((own, pairs, ends), (g_own, g_pairs, g_ends), moments, strict=True):
            g = g / len(table) - decay * x
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # what stands after a word weighs on the word before it: [1] is what a word says of its successor, [2] of its predecessor
    return Field(words, own[:, :FEATURES], pairs, ends[0], ends[1])


def fine(kind: str, text: str) -> bool:
    """Whether what the field found can be of its kind at all."""
    digits = _digits(text)
    if kind == "email":
        return bool(re.search(r"(?i)@|[\[(]at[\])]", text)) and bool(re.search(r"(?i)\.|[\[(]dot[\])]", text))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text)) and all(int(x) < 256 for x in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and bool(re.search(r"[ ().-]", text)) and not re.search(r"[A-Za-z,;:]", text)


def _found(texts: list[str], cut: Cut, labels: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Spans of neighbouring words of one kind, by text, from the first word's to the last one's core."""
    out: dict[int, list] = {}
    at = np.flatnonzero(labels)
    if not len(at):
        return out
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(labels[at]) != 0) | (np.diff(cut.row[at]) > 0)) + 1
    for run in np.split(at, cuts):
        row, kind = int(cut.row[run[0]]), LABELS[labels[run[0]]]
        raw = texts[row].encode()
        a, b = (int(x) - int(cut.borders[row]) for x in (cut.starts[run[0]], cut.ends[run[-1]]))
        start = len(raw[:a].decode())
        own = raw[a:b].decode()
        core = own.rstrip(PUNCTUATION)
        bare = core.lstrip(PUNCTUATION)
        if own.startswith("(") and re.match(r"\([0-9]+\)", own):
            bare = core
        if bare and fine(kind, bare):
            start += len(core) - len(bare)
            out.setdefault(row, []).append((kind, start, start + len(bare)))
    return out


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _tag(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                texts = some.column("text").to_pylist()
                cut = Cut(some.column("text"), BLANKS, lower=False)
                more = _found(texts, cut, model.decode(cut))
                base = [base_spans(t) for t in texts]
                whole = []
                for i, own in enumerate(base):
                    fresh = [s for s in more.get(i, ()) if all(s[2] <= a or b <= s[1] for _, a, b in own)]
                    whole.append(sorted([*own, *fresh], key=lambda s: (s[1], KINDS.index(s[0]))))
                counts = [pa.array([sum(s[0] == kind for s in own) for own in base], pa.int64()) for kind in KINDS]
                digests = [hashlib.sha256(_digest(own).encode()).hexdigest() for own in base]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(_digest, whole), pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame, table: list[tuple[str, list[tuple[str, int, int]]]] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs`` (doc_id, text; others play no part).

    Counts and digest are of the patterns' matches; ``spans`` holds these and what the field adds: obfuscated addresses, phone
    numbers without a plus, cards with other separators. An added span touches no
    pattern's match and passes ``fine``. Null and empty texts have no spans; null and repeated ids stay as they are; no
    rows give no rows. ``table``: labelled (text, spans), by default ``labelled_table()``. The model is sent to tasks
    (3 * FEATURES * 5 numbers, and what the table's words add). Texts are read in slices of SLICE_BYTES or of one text.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(labelled_table() if table is None else table))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_tag(field), _OUT)
