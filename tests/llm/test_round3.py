"""Collocations, personal data and ranked search: brute force, edges, and the methods' own guarantees."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessarine.llm import collocations, pii, search
from tessarine.llm._text import Cut
from tessarine.llm import queries as registered

random.seed(9)
SCHEMA = "doc_id long, text string, lang string, score string, term string, phrase string"
LONG = " ".join(f"l{k % 997}" for k in range(60_000))
ROWS = [(1, "A b, a B. a b", "en", "x", "y", "z"), (1, "A b, a B. a b", "en", "x", "y", "z"), (2, None, "en", None, None, None), (3, "", None, "x", "y", "z"), (None, "a b a b é", None, "x", "y", "z"), (4, LONG, "de", "x", "y", "z"), (5, "a a a a", "en", "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_phrases(rows, most, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, size = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    out = []
    frequent = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in frequent.items():
        if any(ol == lang and len(o) > len(p) and b >= a and any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1)) for (ol, o), b in frequent.items()):
            continue
        s, _, l, r = min((1000 * a * size[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, size[lang], s))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, k + 1, *o[1:]) for k, o in enumerate(own)]
    return sorted(ranked)


def test_phrases_match_brute_force(docs, none):
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=2, top=9).collect())
    assert got == plain_phrases([(r[1], r[2]) for r in ROWS], 5, 2, 9) and got
    assert collocations.collocations(none).count() == 0


def test_summaries_keep_every_frequent_key():
    """Cut far below what was seen, in several merged parts, over partitions of unequal mass."""
    r = np.random.default_rng(3)
    seen = np.concatenate([r.integers(0, 2**64, 300, dtype=np.uint64).repeat(r.integers(1, 60, 300)), np.full(4000, 77, np.uint64), r.integers(0, 2**64, 30_000, dtype=np.uint64)])
    r.shuffle(seen)
    keys, least = collocations.Keys(4, False), 40
    mass = np.bincount(keys.part(seen).astype(int), minlength=4)
    capacity = mass // least + 1
    rows = []
    for part in np.array_split(seen, 7):
        own = collocations.Summaries(keys, capacity)
        for some in np.array_split(part, 3):
            own.add(some)
        rows += own.rows().to_pylist()
    assert max(len(x["counts"]) // 4 for x in rows) <= capacity.max()
    rows.sort(key=lambda x: x["part"])
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("error", pa.int64())])
    kept = set()
    for out in collocations._survivors(keys, capacity, least)(iter([pa.RecordBatch.from_pylist(rows, schema)])):
        for x in out.to_pylist():
            kept |= set(keys.unpacked(x["part"], x["keys"]).tolist())
    own, n = np.unique(seen, return_counts=True)
    frequent = set(keys.of(own[n >= least]).tolist())
    assert frequent <= kept and len(kept) <= len(seen) // least + 4


def test_phrases_of_one_hash_are_told_apart():
    cut = Cut(pa.array(["a b a b c d"]), b" ")
    at, n = collocations._same(cut, np.array([0]), np.zeros(5, np.uint64), np.arange(5), 2)
    assert sorted(n.tolist()) == [1, 1, 1, 2] and len(at) == 4


def test_words_named_like_languages_share_no_hash():
    """``en`` in texts of ``es`` and ``es`` in texts of ``en`` are phrases of their own: only those that share a hash are compared by words."""
    batch = pa.RecordBatch.from_pydict({"text": ["es a", "en a"], "lang": ["en", "es"]})
    [(_, _, seeds, cut)] = collocations._cuts(iter([batch]))
    for n, h in collocations._grams(cut, seeds, 2):
        assert len(np.unique(h[collocations.whole(cut, n)])) == 4 // n


def plain_search(rows, items, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    own = [(i, Counter(cut(t))) for i, t in rows]
    own = [(i, c) for i, c in own if c]
    n, length, df = len(own), sum(sum(c.values()) for _, c in own), Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(cut(text)) if w in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [7, 1 << 16])
def test_search_matches_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "PACK_ITEMS", 2)
    words = [f"w{k}" for k in range(40)]
    rows = [(i if i != 30 else None, " ".join(random.choice(words[: 1 + int(40 * random.random() ** 3)]) for _ in range(random.randrange(0, 30)))) for i in range(120)] + [(5, "w1 w2 W39"), (5, "w1 w2 W39"), (200, None), (201, "é-É w39")]
    items = [(1, "w0, W1 w39"), (2, "w0"), (3, "w38 w39 é nowhere"), (4, None), (5, "nothing known"), (1, "w0, W1 w39"), (None, " ".join(words))]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, term string, score long").coalesce(2)
    got = sorted(map(tuple, search.ranked_search(df, spark.createDataFrame(items, "item_id long, text string"), 5).collect()), key=str)
    assert got == plain_search(rows, list(dict.fromkeys(items)), 5)


def test_search_of_nothing(spark, none, docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked_search(none, items).count() == 0
    assert search.ranked_search(docs, items.limit(0)).count() == 0
    assert {r.doc_id for r in search.ranked_search(docs, items).collect()} == {1, 5, None}


def test_blocks_are_rejected_before_they_are_decoded(monkeypatch):
    """A frequent term's blocks are left alone where a rare term's documents don't lie, and the answer stays exact."""
    monkeypatch.setattr(search, "BLOCK", 16)
    texts = [f"common filler{k % 50} " + ("rare " * 3 if k % 400 == 0 else "") + "pad " * (k % 7) for k in range(4000)]
    batches = list(search.shard_rows(0, pa.array(range(4000), pa.int64()), pa.array(texts), 4000, 20_000, 3))
    rows = [r for b in batches for r in b.to_pylist()]
    m = np.frombuffer(rows[0]["tops"], "<i8")
    lists = {r["term"]: search.Postings(r, m) for r in rows[1:]}
    asked = [(5000, lists["rare"]), (5, lists["common"])]
    docs, scores = search.best(asked, 4000, 0, 3)
    assert lists["common"].read <= 10 < len(lists["common"].ends)
    every = np.zeros(4000, np.int64)
    for w, p in asked:
        d, c = p.all()
        every[d] += w * c
    order = np.lexsort((np.arange(4000), -every))[:3]
    assert docs.tolist() == order.tolist() and scores.tolist() == every[order].tolist()


def test_varints():
    v = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**40])
    assert search.decode(search.encode(v)[0]).tolist() == v.tolist()


# The patterns as stated, for comparison with the linear forms.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def stated(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_patterns():
    r = random.Random(4)
    texts = ["".join(r.choice("aB1290.@-+ ()%_é,") for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += [" ".join(r.choice(["a.b@c.d", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713", "4111 1111 1111 1111", "0007.1.1.1", "a@b.c@d.e", "+123456789", "4111-1111-1111-1111."]) for _ in range(6)) for _ in range(500)]
    assert all(pii.base_spans(t) == stated(t) for t in texts)
    for hostile in ("1" * 300_000, "a." * 200_000, "1 " * 200_000, "+1" + "-" * 200_000, "@" * 200_000, "1." * 200_000):
        pii.base_spans(hostile)


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def test_field_on_held_out_rows(field):
    """Other fillers and invented sentences than it was trained on."""
    rows = pii.labelled_table(seed=99)
    hit = found = wanted = 0
    for text, spans in rows:
        cut = Cut(pa.array([text]), pii.BLANKS, lower=False)
        own = set(pii.base_spans(text)) | set(pii._found([text], cut, field.decode(cut)).get(0, []))
        want = {(k, text[a:b]) for k, a, b in spans}
        got = {(k, text[a:b]) for k, a, b in own}
        hit, found, wanted = hit + len(want & got), found + len(got), wanted + len(want)
    assert hit / wanted > 0.9 and hit / found > 0.9


def test_decoding_is_exact_and_kernels_agree(field, spark, small):
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()] + [t for t, _ in pii.labelled_table()[:60]]
    cut = Cut(pa.array(texts), pii.BLANKS, lower=False)
    labels, scores = field.decode(cut), field.scores(cut)
    yes = np.array([True])
    for row in np.unique(cut.row):
        at = np.flatnonzero(cut.row == row)
        assert field.viterbi(scores[at][None], yes, yes)[0].tolist() == labels[at].tolist()
    known = cut.known.cast(pa.large_string()).cast(pa.string())
    assert np.allclose(field.rows(known), np.stack([field.row(pii.signature(w, field.words)) for w in known.to_pylist()]))


def test_personal_data(spark, none):
    rows = [(1, "é call (415) 234-9876 or +1 (415) 555-0101 now", 1), (2, None, 1), (3, "", 1), (None, "mail jane [at] acme [dot] org please", 1), (3, "nothing. Here and there", 1), (4, "word " * 50_000 + "1.2.3.4", 1)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert len(got) == len(rows) and pii.personal_data(none).count() == 0
    by = {(r.doc_id, r.spans): r for r in got}
    assert (None, "email:5:29") in {(r.doc_id, r.spans) for r in got}
    assert by[1, "phone:7:21,phone:25:42"].base_sha256 == hashlib.sha256(b"phone:25:42").hexdigest() and by[1, "phone:7:21,phone:25:42"].n_phone == 1
    assert by[4, "ip:250000:250007"].n_ip == 1 and by[2, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        pii.train([("a", [])] * (pii.MAX_LABELLED + 1))


def test_registered_personal_data(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in registered.queries()["op12_personal_data"](spark, small).collect():
        base = stated(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(filter(None, r.spans.split(",")))
