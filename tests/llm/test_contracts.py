"""Registered queries against SQL where there is some, else against brute force, on whole small tables."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter

import compare
import numpy as np
import plain
import pytest
from plain import linked_components, lowered

from tessarine.llm import lm
from tessarine.llm import queries as registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, small, name):
    assert compare.differences(spark, duck, small, QUERIES[name], SQL[name]) == ""


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def test_near_duplicates(spark, small, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_near_duplicates"](spark, small).collect()}
    assert got == linked_components(docs)


def test_packing(spark, small, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registered.tokenizer_path())
    want = {}
    for i, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = np.asarray(ids[at : at + 2048], "<u4")
            want[i, piece] = (at, len(own), zlib.crc32(own.tobytes()))
    rows = QUERIES["op4_best_fit_packing"](spark, small).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= math.ceil(total / 2048) * 1.02 + 1


def test_language_model(spark, small, docs):
    train = [lowered(t) for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for ws in train for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in QUERIES["op5_lm_scores"](spark, small).collect()}
    for i, text in docs:
        toks, r = [*lowered(text), None], rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(toks), sum(w in counts for w in toks), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks), rel_tol=1e-9)
    unseen = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    pairs = Counter(p for ws in train for p in zip([None, *ws], [*ws, None], strict=True))
    model = lm.Smoothing(n, v)
    floor = lambda c: float(max((x for x in lm.STEPS if x <= c), default=0))
    above = lambda c: float(min(x for x in lm.STEPS if x > c) - 1) if c else 0.0
    off = []
    for i, text in docs:
        ws = lowered(text)
        found = list(zip([None, *ws], [*ws, None], strict=True))
        want = model.log_p(np.array([floor(pairs[p]) for p in found]), np.array([above(counts[c]) for c, _ in found]), np.array([floor(counts[w]) for _, w in found])).sum()
        off.append(abs(want - rows[i].score) / abs(want))
    # what is left is the filter's own error: one in some hundred absent n-grams and next levels is found
    assert np.mean(off) < 0.003 and max(off) < 0.05


def test_html_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op9_html_text"](spark, small).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_substrings(spark, small, docs):
    """The same text as by plain chunking; kept text and removed spans make up each document."""
    texts, want = dict(docs), plain.without_repeats(docs)
    rows = QUERIES["op3_substring_dedup"](spark, small).collect()
    assert {r.doc_id: r.text for r in rows} == want and any(want[i] != t for i, t in docs)
    for r in rows:
        text, kept, at = texts[r.doc_id], "", 0
        for s in r.spans:
            kept, at = kept + text[at : s.start], s.end
        assert kept + text[at:] == r.text


def test_removed_words_stand_elsewhere(spark, docs):
    """Of all removed words, at most a hundredth lies in no run of ten words that stands twice in the table."""
    runs = Counter(tuple(w[k : k + 10]) for _, t in docs for w in [plain.words(t)] for k in range(len(w) - 9))
    gone = lone = 0
    for r in repeats_of(spark, docs):
        w = plain.words(dict(docs)[r.doc_id])
        twice = {k + j for k in range(len(w) - 9) if runs[tuple(w[k : k + 10])] > 1 for j in range(10)}
        at = [m.start() for m in plain.WORD.finditer(dict(docs)[r.doc_id] or "")]
        own = [k for k, a in enumerate(at) if any(s.start <= a < s.end for s in r.spans)]
        gone, lone = gone + len(own), lone + sum(k not in twice for k in own)
    assert gone > 0 and lone <= 0.01 * gone


def repeats_of(spark, docs):
    from tessarine.llm.substring import remove_repeats

    return remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "spans").collect()


def test_pipeline(spark, duck, small):
    """run() against plain versions of all its stages."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    every = spark.read.parquet(f"{small}/documents.parquet")
    good = {i for i, kept in duck.execute(f"SELECT doc_id, kept FROM ({SQL['op2_quality_rules']})").fetchall() if kept}
    rows = [(r.doc_id, r.text, r.source) for r in every.collect() if r.doc_id in good]
    roots = linked_components([r[:2] for r in rows])
    rows = [r for r in rows if roots[r[0]][1] == r[0]]
    texts = plain.without_repeats([r[:2] for r in rows])
    rows = [(i, texts[i], source) for i, _, source in rows]
    tokenizer, taken, want = Tokenizer.from_file(registered.tokenizer_path()), plain.mixed(rows), Counter()
    for i, text, _ in rows:
        for piece, own in enumerate(plain.pieces(text, tokenizer)):
            want[i, piece, *own] += taken[i]
    packed = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == +want and 0 < len(good) < every.count() and len(rows) < len(good)
    rooms = Counter()
    for r in packed:
        rooms[r.sequence_id] += r.length
    assert max(rooms.values()) <= 2048 and len(rooms) <= math.ceil(sum(rooms.values()) / 2048) * 1.02 + 1
    assert all(stage(spark, every, small).columns == every.columns for _, stage in corpus_pipeline.STAGES[:-1])


def test_pipeline_edges(spark, tmp_path):
    """No rows give no rows; null and empty texts, null ids, repeated rows and more columns pass through every stage."""
    import corpus_pipeline

    text = " ".join(f"{('the', 'of', 'and', 'to')[k % 4]} word{k}" for k in range(60))
    rows = [(1, text, "s0", 1), (1, text, "s0", 1), (None, text + " x", None, 2), (3, None, "s0", 3), (4, "", "s1", 4), (5, "z " + text[::-1], "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    for some in (docs, docs.limit(0)):
        path = str(tmp_path / str(some.count()))
        some.write.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, path).columns == docs.columns
        packed = corpus_pipeline.run(spark, path).collect()
        assert ({r.doc_id for r in packed} <= {1, None}) and (len(packed) > 0) == (some is docs)
