"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarine.llm import chat, html, lm, mixing, near_dedup, packing, quality, substring, topk, warc
from tessarine.llm.queries import tokenizer_path

random.seed(5)
PLAIN = " ".join(random.choice(["the", "of", "and"]) if k % 3 == 0 else f"w{random.randrange(900)}" for k in range(120))
PASSAGE = " ".join(f"p{k}" for k in range(60))
LONG = " ".join(f"x{k % 7919}" for k in range(40_000))
ROWS = [
    (1, PLAIN, "src0", "a"), (2, PLAIN, "src0", "b"), (2, PLAIN, "src0", "b"), (3, None, None, "c"), (4, "", "src1", None), (None, PLAIN + " z", "src1", "d"), (5, LONG, "src1", "e"),
    (6, "q1 q2 q3 " * 30 + PASSAGE, "src2", "f"), (7, "r1 r2 r5 " + PASSAGE + " r9", None, "g"), (8, " \n\t ", "src2", "h"), (9, "one two", "src2", "h"), (10, "One TWO", "src2", "h"),
]
SCHEMA = "doc_id long, text string, source string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, none):
    rows = near_dedup.near_duplicates(docs).collect()
    found = {(r.doc_id, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(ROWS) and {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (8, 8, True), (9, 9, True), (10, 9, False), (None, None, True)} <= found
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in near_dedup.components(edges).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}


def test_components_of_nodes_with_many_neighbours(spark):
    star = [(5, i) for i in range(1000, 3000)] + [(i, 900_000 + i) for i in range(1000, 1400)] + [(2, 900_001 + 1000)]
    edges = spark.createDataFrame(star, "a long, b long")
    assert {(r.node, r.root) for r in near_dedup.components(edges).collect()} == {(x, 2) for pair in star for x in pair}


@pytest.mark.parametrize("split", [256, 4])
def test_loose_group_of_copies(spark, monkeypatch, split):
    """A large group of which the hub links to a part only, in one block and in several."""
    monkeypatch.setattr(near_dedup, "SPLIT_ABOVE", split)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in random.sample(range(200), 1 + i % 12):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(60):
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_quality(docs, none):
    rows = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert rows[1].kept and rows[3].base_failed and rows[4].n_words == 0 and rows[8].base_failed and rows[6].n_repeat_words == 90
    assert quality.quality_verdicts(none).count() == 0
    kept = quality.keep_good(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, r in rows.items() if r.kept for _ in range(1 + (i == 2))) and kept.columns == docs.columns


def test_substrings(docs, none):
    rows = [(r.row.doc_id, r.text, len(r.spans), r.copied_from) for r in substring.remove_repeats(docs).collect()]
    by = {i: (t, n, c) for i, t, n, c in rows}
    assert by[1][1] == 0 and by[2] == ("", 1, [1]) and by[3][0] is None and by[4][0] == "" and by[7][1] == 1 and by[7][2] == [6] and len(by[7][0]) < 120
    assert sum(i == 2 for i, *_ in rows) == 2 and substring.remove_repeats(none).count() == 0
    assert substring.drop_repeats(docs).columns == docs.columns


def test_only_passages_that_stood_together_go(spark):
    """Prose of chunks that all occur elsewhere, but never in this order, stays whole; planted copies of 51 words go."""
    rng = random.Random(11)
    own = lambda n, tag: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    vocabulary = [f"v{k}" for k in range(4)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=600))) for i in range(40)]
    passages = [own(51, f"p{i}x") for i in range(20)]
    rows += [(100 + i, " ".join([*own(40, "a"), *p, *own(40, "b")])) for i, p in enumerate(passages)]
    rows += [(200 + i, " ".join([*own(30, "c"), *p, *own(30, "d")])) for i, p in enumerate(passages)]
    texts = dict(rows)
    for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "text", "spans", "copied_from").collect():
        if r.doc_id < 200:
            assert r.text == texts[r.doc_id] and not r.spans and not r.copied_from
        else:
            words = r.text.split()
            passage = passages[r.doc_id - 200]
            assert r.copied_from == [r.doc_id - 100] and not any(" ".join(passage[k : k + substring.MIN_WORDS]) in r.text for k in range(51 - substring.MIN_WORDS + 1))
            assert sum(w[0] in "cd" for w in words) == 60


def test_many_rows_of_one_owner_are_told_apart(spark):
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(words[:60])
    texts = [f"{passage} " + " ".join(words[100 + 50 * i : 150 + 50 * i]) for i in range(40)]
    rows = [(1, passage)] + [(None, t) for t in texts for _ in range(3)] + [(7, t) for t in texts[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    joined = [r.copied_from for r in substring.remove_repeats(docs).filter("row.doc_id is null").collect()]
    assert len(joined) == 120 and all(1 in x for x in joined)
    kept = substring.drop_repeats(docs).collect()
    assert sorted((r.doc_id or 0) for r in kept) == sorted((d or 0) for d, _ in rows)
    assert all("w30" not in r.text.split() for r in kept if r.doc_id != 1)
    assert all(words[125 + 50 * i] in " ".join(r.text for r in kept if r.doc_id == 7).split() for i in range(5))


def test_windows_cover_a_copied_run():
    raw = (" ".join(f"y{k * k % 1009}" for k in range(300))).encode()
    ends, first, last, digests = substring.windows(raw)
    upto = np.concatenate([[0], np.cumsum(substring.chunks(raw)[1])])
    assert (upto[last] - upto[first] >= substring.MIN_WORDS).all() and len(set(digests.tolist())) == len(digests)
    for a in range(0, len(ends), 3):
        for b in range(a + 1, len(ends) + 1):
            inside = [(i, j) for i, j in zip(first, last, strict=True) if a <= i and j <= b]
            assert ({k for i, j in inside for k in range(i, j)} == set(range(a, b))) == (upto[b] - upto[a] >= substring.MIN_WORDS)


def test_chunks_cover_and_resist_shifts():
    raw = LONG.encode()
    ends, words = substring.chunks(raw)
    assert ends[-1] == len(raw) and (np.diff(ends) > 0).all() and words.sum() == 40_000 and words.max() <= substring.MAX_WORDS
    a, b = set(substring._digests(raw, ends)), set(substring._digests(b"new words " + raw, substring.chunks(b"new words " + raw)[0]))
    assert len(a - b) <= 6  # the first chunk, and those whose borders lie within the 16 bytes that the hash looks back
    for odd in (b"", b" ", b"a", b" a", b"a ", b" a b ", b"\n\n"):
        e, w = substring.chunks(odd)
        assert (e[-1] if len(e) else 0) == len(odd) and w.sum() == len(odd.split())


def test_packing(docs, none):
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS} and sum(r.length for r in rows if r.doc_id in (3, 4, 8)) == 3
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_best_fit():
    lengths = sorted((random.randrange(1, 101) for _ in range(500)), reverse=True)
    chosen, offsets = packing.best_fit(lengths, 100)
    room = {}
    for n, c, o in zip(lengths, chosen, offsets, strict=True):
        fits = [r for r in room.values() if r >= n]
        assert (c not in room) == (not fits) and o == 100 - room.get(c, 100)
        if fits:
            assert room[c] == min(fits)
        room[c] = room.get(c, 100) - n


def test_language_model(docs, none):
    rows = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert rows[3].n_tokens == rows[4].n_tokens == rows[8].n_tokens == 1 and rows[None].held_out
    assert all(r.score < 0 and r.base_score < 0 for r in rows.values())
    assert lm.score_documents(none).count() == 0


def test_large_filters_give_the_same_scores(docs, monkeypatch):
    """Scores don't depend on which words' exact counts are broadcast, and a filter that isn't broadcast gives the same ones."""
    rounded = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs).collect())
    whole = rounded()
    monkeypatch.setattr(lm, "HOT_TOKENS", 50)
    some = rounded()
    assert some == whole
    monkeypatch.setattr(lm, "BROADCAST_BYTES", 0)
    assert rounded() == some
    assert [lm.n_segments(n) for n in (0, 10**9, 10**14)] == [32, 64, lm.MOST_SEGMENTS]


def filter_of(keys, counts):
    bits = lm.segment_bits(keys, counts)
    return lm.CountFilter(bits, np.array([8 * len(bits)]))


def test_count_filter_rounds_down():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 4000).astype(np.uint64)
    counts = np.concatenate([np.ones(3000), rng.integers(2, 5000, 1000)]).astype(int)
    f = filter_of(keys, counts)
    got = f.counts(keys)
    low = np.array([max(x for x in lm.STEPS if x <= c) for c in counts.tolist()])
    assert (got >= low).all() and (got > low).mean() < 3 * lm.MISTAKEN + 0.002 and (lm.at_most(low) >= counts).all()
    assert (f.counts(rng.integers(0, 2**63, 100_000).astype(np.uint64)) > 0).mean() < 1.2 * lm.MISTAKEN


def test_counts_are_asked_of_the_filter_once(monkeypatch):
    monkeypatch.setattr(lm, "RECALLED_BITS", 12)
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2))
    f = filter_of(keys[::2], rng.integers(1, 5000, len(keys[::2])))
    recalled, asked, counts = lm.Recalled(f), [], f.counts
    monkeypatch.setattr(f, "counts", lambda k: asked.append(len(k)) or counts(k))
    for own in (keys, keys[::3], keys[:100], keys[:0], keys):
        assert (recalled.counts(own) == counts(own)).all()
    few = keys[::400]
    recalled = lm.Recalled(f)
    asked.clear()
    assert (recalled.counts(few) == recalled.counts(few)).all() and asked[0] == len(few) and asked[1] < len(few) // 10


def test_probabilities_sum_to_at_most_one():
    """After rare and frequent words alike, over the whole vocabulary, whatever the filter finds by mistake; and most of the mass is there."""
    rng = np.random.default_rng(2)
    toks = np.append(np.minimum(rng.zipf(1.3, 60_000), 9_000), 9_001).astype(np.uint64)
    before = lm.contexts(toks)
    before[0] = toks[-1]
    types, n = np.unique(toks, return_counts=True)
    pairs, m = np.unique(lm.pair_keys(before, toks), return_counts=True)
    f = filter_of(np.concatenate([lm.unigram_keys(types), pairs]), np.concatenate([n, m]))
    smoothing = lm.Smoothing(len(toks), len(types))
    low = f.counts(lm.unigram_keys(types))
    by_count = {}
    for k in [*range(0, len(types), 7), int(np.argmax(n))]:
        pair = f.counts(lm.pair_keys(np.full(len(types), types[k]), types))
        sums = {exact: (10 ** smoothing.log_p(pair, np.full(len(types), float(n[k]) if exact else lm.at_most(low[k : k + 1])[0]), n if exact else low)).sum() for exact in (False, True)}
        assert max(sums.values()) <= 1.0, (n[k], sums)
        by_count[n[k]] = sums[True]
    assert max(by_count.values()) > 0.75 and min(by_count.values()) > 0.4


PAGES = [(1, "http://a.com/x", "p" * 200), (2, "http://b.com/y", "p" * 200), (3, None, None), (4, "http://a.com/x", "short"), (5, "http://a.com/x", "short"), (None, "http://c.com", "p" * 200), (7, "http://a.com/x", "é" * 60), (7, "http://a.com/x", "é" * 60)]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=str)
    want = [(1, 200, "response", None), (2, 200, "revisit", 1), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (None, 200, "revisit", 1), (7, 120, "response", None), (7, 120, "response", None)]
    assert rows == sorted(want, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_lookup_of_absent_captures(spark):
    from tessarine.llm._work import work_path

    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string")
    uri = work_path(spark, "absent")
    parts = warc.write_archives(pages, uri)
    assert warc.read_archives(pages, parts, uri).rdd.getNumPartitions() == parts.count() > 1
    raw = [r.content for r in spark.read.format("binaryFile").load(uri + "/*.warc.gz").collect()]
    records = [warc.parse_record(b"WARC/1.1" + r)["fields"] for x in raw for r in gzip.decompress(x).split(b"WARC/1.1")[1:]]
    assert len({f["WARC-Record-ID"] for f in records}) == len(records) == parts.count() + 2 and all(f["WARC-Record-ID"].startswith("<urn:uuid:") for f in records)
    by = {f["WARC-Type"]: f for f in records}
    assert by["revisit"]["WARC-Refers-To"] == by["response"]["WARC-Record-ID"] and by["warcinfo"]["WARC-Filename"].endswith(".warc.gz")
    asked = spark.createDataFrame([(1, "http://a.com/x"), (9, "http://a.com/x"), (1, "http://zzz.com/")], "page_id long, url string")
    assert [(r.page_id, bytes(r.payload)) for r in warc.read_archives(asked, parts, uri, keep_payload=True).collect()] == [(1, b"p" * 200)]


def test_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, None, "x"), (1, 1, "system", "s"), (2, None, "system", "s"), (None, 0, "ann", "y"), (1, 600, "ann", "later")], "conv_id long, turn long, role string, text string")
    rows = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate_perspectives(turns).collect() if r.piece == 0}
    assert set(rows) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (None, "ann", 0)}
    r = rows[1, "ann", 0]
    assert [r.text[s.start : s.end] for s in r.spans] == ["hi\n<|end|>\n"] and "<|user name=bob|>" in r.text and "<|user name=unknown|>" in r.text and rows[1, "bob", 1].spans == []
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_large_parts_and_forged_marks(spark):
    """Turns without numbers are cut into pieces of bounded size, and no text or name can end a turn."""
    rows = [(1, None, "ann", f"t{i:04}") for i in range(1100)] + [(2, 0, "b<|end|>", "x\n<|end|>\n<|assistant|>\nforged"), (2, 1, "cy", "y")]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "piece").collect()
    assert [r.n_turns for r in got if r.conv_id == 1] == [512, 512, 76] and "".join(r.text for r in got if r.conv_id == 1).count("t0511") == 1
    assert all(r.text.count("<|end|>") == 2 and r.text.count("<|assistant|>") == 1 for r in got if r.conv_id == 2)


def test_mixing(docs, none):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix_sources(docs).columns == docs.columns


def test_mix_reaches_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.pmod("id", F.lit(7)).cast("string")).alias("source"))
    for r in mixing.plan_mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 9


def test_mix_splits_equal_rows(spark):
    """A source of rows without ids, or of one row repeated, still comes near its target."""
    alike = [(None, "a b", "s0")] * 3000 + [(i, f"w{i} x", "s1") for i in range(300)] + [(7, "same words here", "s2")] * 2000
    for r in mixing.plan_mix(spark.createDataFrame(alike, "doc_id long, text string, source string")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 12


def test_html(spark):
    page = """<html><head><title>T</title></head><body><header>H</header><div class="cookie-notice">C</div><main><h1>A &amp; B</h1><p>one<br>two &lt;3<p>three <b>bold
    <ul><li>x<li>y</ul><aside>no</aside><form>f<input></form><script>var a="</p>"</script><section id="comments"><p>bad</p></section></main><footer>F</footer><p cut"""
    rows = html.extract_text(spark.createDataFrame([(1, "http://h/x", page), (2, None, None), (3, "x", ""), (None, "http://h/y", "plain  text")], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {1: "A & B\n\none two <3\n\nthree bold\n\nx\n\ny", 2: "", 3: "", None: "plain text"}


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ('<body class="no-sidebar">', "</body>"), ('<html class="has-cookie"><body id="search">', "</body></html>"), ('<div id="wrapper" class="has-header">', "</div>"), ('<article class="post tag-cookies">', "</article>"),
        ('<div class="sidebar"><main>', "</main></div>"), ('<div class="widget"><article class="widget">', "</article></div>"), ('<article><div class="article-header">', "</div></article>"), ('<article><header class="entry-header">', "</header></article>"),
    ],
)
def test_names_that_are_no_noise(before, after):
    title = "<h1>Title</h1>"
    assert html.main_text(f"{before}{title}{after}") == "Title"


@pytest.mark.parametrize("name", ["sidebar", "site-header", "cookie-notice", "post-comments", "widget_text-2", "main-nav"])
def test_names_that_are_noise(name):
    assert html.main_text(f'<article><p>a</p><div class="x {name}"><article>b</article></div></article><div id="{name}"><article>c</article></div>') == "a"


def test_style_tree_removes_what_pages_repeat(spark):
    pages = [(i, f"http://h/{i}", f"<body><div class='x'>Same words on all pages</div><div class='y'><p>Story {i} of its own</p></div></body>") for i in range(8)]
    rows = html.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in rows} == {f"Story {i} of its own" for i in range(8)}


@pytest.mark.parametrize("around", ["<body>{}</body>", "<body><article class='post'>{}</article></body>"])
def test_copies_of_a_page_are_no_evidence(spark, around):
    """A page that a host has many times, also with another menu, keeps its text; what distinct pages repeat still goes."""
    page = around.format("<div class='s'><p>One story</p></div>")
    pages = [(i, f"http://copies/{i}", page if i % 2 else page.replace("<body>", "<body><nav>print</nav>")) for i in range(8)]
    own = around.format("<div class='x'>Same words on all pages</div><div class='y'><p>Story {}</p></div>")
    pages += [(10 + i, f"http://h/{i}", own.format(i % 6)) for i in range(24)]
    rows = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows == {i: "One story" for i in range(8)} | {10 + i: f"Story {i % 6}" for i in range(24)}


def test_deep_pages_formulas_and_repeated_articles(spark):
    """Paths of any depth are told apart, formulas stay, and pages that share all their text keep it."""
    deep = "<div>" * 400 + "<div class='{}'><p>{}</p></div>" + "</div>" * 400
    pages = [(i, f"http://deep/{i}", "<body>" + deep.format("menu-of-all", "Same words") + deep.format("own", f"Story {i}") + "</body>") for i in range(6)]
    pages += [(10 + i, f"http://same/{i}", f"<body><article><p>All pages tell this</p></article><footer>{i}</footer></body>") for i in range(6)]
    pages += [(20 + i, f"http://boiler/{i}", f"<body><article><div><p>Share this story</p></div><section><p>Let <math><mi>x</mi></math> be {i}</p></section></article></body>") for i in range(6)]
    rows = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows == {i: f"Story {i}" for i in range(6)} | {10 + i: "All pages tell this" for i in range(6)} | {20 + i: f"Let x be {i}" for i in range(6)}


def test_long_pages_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>w{i} {'x' * 50}</p>" for i in range(20_000)) + "</article>"
    pages = spark.createDataFrame([(1, "http://h/1", long, "a", 5), (1, "http://h/1", long, "a", 5)], "page_id long, url string, html string, text string, low int")
    rows = html.extract_text(pages).collect()
    assert [r.n_chars for r in rows] == [len(rows[0].text)] * 2 and rows[0].text.count("\n\n") == 19_999
    kept = warc.archive_round_trip(pages.withColumnRenamed("low", "digest").withColumnRenamed("text", "key")).collect()
    assert [(r.payload_bytes, r.record_type) for r in kept] == [(len(long), "response")] * 2


def test_top_k(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (50, [float("nan"), 1.0], 1), (100, [], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1), (6, [9.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 589824), (0, 2, 1, 49152), (0, 3, 2, 49152), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 2, 0)]
    assert topk.top_k(v.limit(0)).count() == 0


def test_rows_of_one_id_are_queries_of_their_own(spark):
    """Also equal ones: each has its own ranks and the other among its candidates."""
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [2.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score >> 16) for r in topk.top_k(v, k=2).collect())
    assert got == sorted([(0, 1, 7, 2), (0, 2, 50, 1), (0, 1, 7, 1), (0, 2, 50, 1), (50, 1, 7, 3), (50, 2, 50, 2)] + [(50, 1, 7, 3), (50, 2, 50, 2)])


def test_pruning_skips_blocks():
    rng = np.random.default_rng(3)
    weights = [rng.integers(0, 9, (50, 8)) + (100 if b == 0 else 0) for b in range(6)]
    ids = [np.arange(b * 50, b * 50 + 50) for b in range(6)]
    (_, best, scored), = topk.search((np.array([-1]), np.ones((1, 8), np.int64)), ids, ids, weights, 5)
    flat = sorted(((-int(w.sum()), int(i)) for ws, own in zip(weights, ids, strict=True) for w, i in zip(ws, own, strict=True)))[:5]
    assert best == [(-s, i) for s, i in flat] and scored == 1
