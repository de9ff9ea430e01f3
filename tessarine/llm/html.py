"""Main text of web pages by site style trees.

The DOMs of one host are merged into a tree of presentation paths (block tags with their first class or id, known by a
hash chain from the root, however deep). Every node counts, over the host's distinct pages, in how many ways it is
presented (the tags below it) and how its contents spread: text that all pages repeat has high entropy and no importance,
text of its own on each page has much. Branches of low importance are removed from each page, with those whose tags or
names say that they are no article; where that would leave nothing of an article, the tree removes nothing from the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.llm._work import join_counted, materialize

LEAST_PAGES = 3
"""A host with fewer distinct pages at a node says nothing about it: two pages that share a passage may both be articles."""
LOW = 0.25
"""Branches of less composite importance go."""
CONTENT_SHARE = 0.9
BROADCAST_PATHS = 200_000

#: The block elements of HTML, raw-text elements, void elements, and elements that hold no article text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea title svg iframe object noframes noembed xmp canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_ARTICLE = frozenset("head nav header footer aside form menu dialog button select option datalist label fieldset search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names for page parts that are no article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion related "
    "reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Words that beside a noise word in one class or id leave it noise ("site-header"), and the parts of an article's surroundings ("post-comments").
BESIDE_NOISE = frozenset(
    "area bar block bottom box button buttons container content fixed form global group icons inline inner item items left links list main page panel posts primary "
    "right row secondary section site slot sticky text top unit wrap wrapper".split()
)
OF_ARTICLE = frozenset("article entry post".split())
AROUND_ARTICLE = frozenset("ad ads comment comments commentlist nav navigation newsletter pagination related replies respond share sharing social sponsor subscribe".split())
#: Elements that no name makes noise.
NEVER_BY_NAME = frozenset("html body main".split())
#: Roles of ARIA landmarks that are no article.
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    """Hash of the labels from the root."""
    label: str
    main: bool
    over: Node | None = None
    named: bool = False
    """A class or id says noise."""
    hard: bool = False
    """The tag, a role or being hidden says noise."""
    noise: bool = False
    """It or an element around it is noise."""
    below: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    node: Node
    text: str


def noise_name(name: str) -> bool:
    """Whether one class or id is a noise word, or a known compound with one."""
    words = [w.lower() for w in _WORD.findall(name)]
    if len(words) > 1 and words[0] in OF_ARTICLE:
        return words[1] in AROUND_ARTICLE and all(w in NOISE_WORDS or w in BESIDE_NOISE for w in words[1:])
    return any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in BESIDE_NOISE for w in words)


def _named(attrs: str) -> tuple[str, bool, bool, bool]:
    """(label, is noise by class or id, is noise otherwise, is main) that an element's attributes say."""
    label, named, noise, main = "", False, False, False
    for m in _NAMES.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if value and not label:
                label = "." + value.split()[0].lower() if value.split() else ""
            named |= any(map(noise_name, value.split()))
        elif name == "role":
            noise |= value.strip().lower() in NOISE_ROLES
            main |= value.strip().lower() == "main"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN_STYLE.search(value):
            noise = True
    return label, named, noise, main


def _around(node: Node) -> Iterator[Node]:
    while node := node.over:
        yield node


def _resolve(nodes: list[Node]) -> None:
    """Noise is inherited, but by no heading in the header of an article."""
    for n in nodes:
        n.noise = n.hard or n.named or n.over.noise and not (n.tag in HEADINGS and n.over.tag == "header" and n.over.main)


def read_page(html: str) -> tuple[list[Block], list[Node]]:
    """Blocks of text in page order and all block elements of a page.

    Names make no noise of html, body, main or an outer article, nor of what holds a main element, nor of what holds
    articles where the page has no article or main element elsewhere.
    """
    root = Node("", 0, "", False)
    stack, nodes, blocks, parts = [root], [], [], []

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(stack[-1], text))
            parts.clear()

    def close(tags: set[str], within: frozenset[str] | None = None) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if within and stack[k].tag in within:
                return

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if tag not in BLOCKS and tag not in NO_ARTICLE:
            if tag in ("br", "img", "wbr", "input"):
                parts.append(" ")
            continue
        if closing:
            close({tag})
            continue
        flush()
        close({"p"}, frozenset({"div", "section", "article", "td", "li", "blockquote", "main"}) if tag in BLOCKS else None)
        if tag in _CLOSED_BY:
            close(_CLOSED_BY[tag], frozenset({"ul", "ol", "dl", "table", "select", "menu"}))
        if tag in VOID or attrs.endswith("/") and tag == "hr":
            continue
        over = stack[-1]
        label, named, hard, main = _named(attrs)
        is_main = main or tag == "main"
        named &= not is_main and tag not in NEVER_BY_NAME and not (tag == "article" and all(n.tag != "article" for n in stack))
        node = Node(tag, _hash(f"{over.path}/{tag}{label}"), label, is_main or tag == "article" or over.main, over, named, hard or tag in NO_ARTICLE)
        if is_main:
            for n in stack:
                n.named = False
        over.below.append(tag + label)
        stack.append(node)
        nodes.append(node)
    flush()
    _resolve(nodes)
    if not any(b.node.main and not b.node.noise for b in blocks):
        around = [n for a in nodes if a.tag == "article" and not a.hard and not any(n.hard for n in _around(a)) for n in _around(a) if n.named]
        for n in around:
            n.named = False
        if around:
            _resolve(nodes)
    return blocks, nodes


def _joined(blocks: list[Block], low: frozenset[int] | set[int] = frozenset()) -> str:
    within = any(b.node.main and not b.node.noise for b in blocks)
    article = [b for b in blocks if not b.node.noise and (b.node.main or not within)]
    kept = [b for b in article if not any(n.path in low for n in (b.node, *_around(b.node)))] if low else article
    return "\n\n".join(b.text for b in kept or article)


def main_text(html: str | None, low: frozenset[int] | set[int] = frozenset()) -> str:
    """Article blocks of a page joined by blank lines. ``low``: paths of branches of low importance on its host.

    Where a page has article or main elements, only they count. Where all that is left lies in low branches, it stays.
    """
    return _joined(read_page(html or "")[0], low)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> for each page: the digest of its text, and for each path those of its presentation and of its texts, each once a page."""
    for batch in batches:
        texts, nodes_of = [], []
        for page in batch.column("html"):
            blocks, nodes = read_page(page.as_py() or "")
            own = {(n.path, 0, _hash(" ".join(n.below))) for n in nodes if not n.noise} | {(b.node.path, 1, _hash(b.text)) for b in blocks if not b.node.noise}
            texts.append(xxhash.xxh3_128_digest(_joined(blocks).encode("utf-8", "replace")))
            nodes_of.append([{"path": path, "kind": kind, "digest": digest} for path, kind, digest in sorted(own)])
        kind = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("digest", pa.int64())]))
        yield pa.record_batch([batch.column("host"), pa.array(texts, pa.binary()), pa.array(nodes_of, kind)], ["host", "page", "nodes"])


def host_of() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, importance) of every node of the hosts' style trees.

    Pages of a host with the same text (copies, print or mirror URLs) are one page, the least of them by its nodes.
    Presentation counts by the entropy of the node's styles, content by one minus the mean entropy of its texts, both
    with logarithms to the base of the node's pages; a node of one page has importance 1.
    """
    told_by = pages.select(host_of().alias("host"), "html").mapInArrow(_tree, "host string, page binary, nodes array<struct<path:bigint,kind:int,digest:bigint>>")
    distinct = told_by.groupBy("host", "page").agg(F.min("nodes").alias("nodes"))
    each = distinct.select("host", F.inline("nodes"))
    counted = each.groupBy("host", "path", "kind", "digest").agg(F.count(F.lit(1)).alias("n"))
    n, style, content = F.col("n"), F.col("kind") == 0, F.col("kind") == 1
    summed = counted.groupBy("host", "path").agg(
        F.sum(F.when(style, n)).alias("n_pages"),
        F.sum(F.when(style, n * F.log(n))).alias("style_log"),
        F.sum(F.when(content, F.log(n))).alias("text_log"),
        F.count(F.when(content, 1)).alias("texts"),
    )
    m = F.log("n_pages")
    presented = (F.log("n_pages") - F.col("style_log") / F.col("n_pages")) / m
    told = F.when(F.col("texts") == 0, 1.0).otherwise(1 - F.col("text_log") / (F.col("texts") * m))
    importance = F.when(F.col("n_pages") > 1, (1 - CONTENT_SHARE) * presented + CONTENT_SHARE * told).otherwise(1.0)
    return summed.select("host", "path", "n_pages", importance.alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py(), set(low or ())) for page, low in zip(batch.column("html"), batch.column("low").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A null or empty html has an empty text. A null URL is the host ''. Null page_ids and repeated rows are rows like
    others; other columns are ignored. White space inside a block becomes one space and blocks are joined by a blank
    line; nothing is cut short. No rows give no rows.
    """
    tree = style_tree(pages).filter((F.col("n_pages") >= LEAST_PAGES) & (F.col("importance") < LOW))
    low = materialize(tree.groupBy("host").agg(F.collect_list("path").alias("low"), F.count(F.lit(1)).alias("paths")), "low")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    if (low.agg(F.sum("paths")).first()[0] or 0) <= BROADCAST_PATHS:
        joined = source.join(F.broadcast(low.drop("paths")), "host", "left")
    else:
        counts = source.groupBy("host").agg(F.count(F.lit(1)).alias("n_rows"))
        joined = join_counted(source, counts.join(low.drop("paths"), "host", "left"), "host", source.count())
    done = joined.select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))
