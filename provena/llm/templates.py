"""Main text of pages by removal of site templates: element subtrees that recur over the pages of a host are deleted.

A task reads each page once. It hashes the subtree of every element by its tags and text, and cuts the page into blocks of
text, each with its place; a subtree covers an interval of places. Spark counts the pages of a host that hold a subtree.
Subtrees on many of them are template: their intervals go. Elements that say by name, role or class that they are menus,
notices and the like go too, so that a page whose host has few others is freed of them as well. The article's own inside
is kept even where it recurs: passages and whole articles may stand on many pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import materialize
from provena.llm.url_filters import host_of

LEAST_PAGES = 3  # pages of a host that a template stands on, at least
SHARE = 0.01  # and this share of the host's pages, so that a host has at most 100 times the subtrees of its mean page
BATCH = 512  # pages whose results are handed on together

# Elements and words by which pages name their parts.
RAW = frozenset("script style textarea title iframe noembed noframes xmp plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head nav footer aside form button select datalist dialog menu noscript template svg math canvas object audio video map fieldset".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
CELLS = frozenset("td th table caption template".split())
TABLE = frozenset("table tr tbody thead tfoot body html".split())
ABOVE_P = CELLS | {"button", "#page"}
HEADS = frozenset("html head base link meta noscript template".split())
PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 table dl".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored promo promotion".split())
READERS = frozenset("comment comments commentlist disqus respond replies".split())
AROUND = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal banner newsletter subscribe subscription signup login search share sharing social related recommended widget toolbar pagination pager skip skiplink".split())
SITE = frozenset("header masthead topbar".split())  # outside the article only

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*)>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_WITHOUT = re.compile(r"\b(?:no|has|with|without)[-_][a-z0-9]+")  # a page with-sidebar is none


class Node:
    __slots__ = ("tag", "up", "block", "words", "role", "body", "parts", "first", "last", "digest", "prose", "hidden")

    def __init__(self, tag: str, up: int, first: int, attributes: str):
        self.tag, self.up, self.first, self.last = tag, up, first, first - 1
        self.block = -1  # the element that ends a line of text here: itself, or what an inline element stands in
        self.words, self.role, self.body, self.hidden = frozenset(), "", False, False
        self.parts: list[bytes] = []
        self.digest, self.prose = 0, 0
        if attributes:
            for m in _NAMED.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id"):
                    self.words |= frozenset(_WORD.findall(_WITHOUT.sub(" ", value)))
                elif name == "role":
                    self.role = value.strip()
                elif name == "itemprop":
                    self.body |= value.strip() == "articlebody"
                elif name == "style":
                    self.hidden |= "display:none" in value.replace(" ", "")
                else:
                    self.hidden |= name == "hidden" or value == "true"


class Page(NamedTuple):
    """A page's elements in order of their start, and its blocks of text, each with the element that it ends in."""

    nodes: list[Node]
    blocks: list[tuple[str, int]]


def read_page(text: str) -> Page:
    """Elements and blocks of a page, as forgiving as browsers are: ends may be left out, be in excess or cross each other."""
    nodes, blocks = [Node("#page", -1, 0, "")], []
    nodes[0].block = 0
    stack, run, links = [0], [], 0

    def flush() -> None:
        nonlocal links
        said = " ".join("".join(run).split())
        run.clear()
        if said:
            at = nodes[nodes[stack[-1]].block]
            blocks.append((said, nodes[stack[-1]].block))
            at.parts.append(said.encode("utf-8", "replace"))
            at.prose += max(0, len(said) - links)
        links = 0

    def close(depth: int) -> None:
        """End the elements of the stack from a depth on."""
        if run and any(nodes[i].block == i for i in stack[depth:]):
            flush()
        while len(stack) > depth:
            i = stack.pop()
            n = nodes[i]
            if n.block != i:
                continue
            n.last = len(blocks) - 1
            if n.parts:
                n.digest = xxhash.xxh64_intdigest(b"\x00".join([n.tag.encode("utf-8", "replace"), *n.parts])) - (1 << 63)
                nodes[nodes[n.up].block].parts.append(n.digest.to_bytes(8, "little", signed=True))

    def end_before(tags: set[str], barrier: set[str] | frozenset[str]) -> None:
        """End an open element of these tags that no barrier stands before."""
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]].tag
            if tag in tags:
                close(depth)
                return
            if tag in barrier:
                return

    def start(tag: str, attributes: str) -> Node:
        n = Node(tag, stack[-1], len(blocks), attributes)
        n.block = len(nodes) if tag not in INLINE else nodes[stack[-1]].block
        nodes.append(n)
        stack.append(len(nodes) - 1)
        return n

    at, size = 0, len(text)
    while at < size:
        m = _TAG.search(text, at)
        stop = m.start() if m else size
        if stop > at:
            said = text[at:stop]
            run.append(html.unescape(said) if "&" in said else said)
            if nodes[stack[-1]].tag == "a":
                links += len(said)
        if not m:
            break
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if run and tag not in INLINE:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                open_ = nodes[stack[depth]].tag
                if open_ == tag:
                    close(depth)
                    break
                if (tag in INLINE and open_ not in INLINE) or (open_ in CELLS and tag not in TABLE):
                    break
        elif tag in RAW:
            rest = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = rest.end() if rest else size
        elif tag in VOID:
            if tag == "br":
                run.append("\n")
            elif run and tag not in INLINE:
                flush()
        elif tag in INLINE:
            n = Node(tag, 0, 0, attributes) if attributes else None
            if n and (n.words & ADVERTS or n.hidden):  # such a part of a line is a block of its own, so that it can go
                flush()
                n = start(tag, attributes)
                n.block = len(nodes) - 1
            else:
                start(tag, "")
        else:
            if run:
                flush()
            if tag in ENDS_P:
                end_before({"p"}, ABOVE_P)
            if tag in SIBLINGS:
                end_before(*SIBLINGS[tag])
            if tag not in HEADS:
                end_before({"head"}, {"body"})
            start(tag, attributes)
    flush()
    close(1)
    nodes[0].last = len(blocks) - 1
    return Page(nodes, blocks)


class Reading(NamedTuple):
    """What counts of a page: (hash, first, last) of subtrees that go where they recur, and the blocks that stay otherwise."""

    subtrees: list[tuple[int, int, int]]
    blocks: list[str]


def _named_other(x: Node, weak: bool) -> bool:
    """Whether an element says that it is something other than the article; weakly by words of its class or id alone."""
    if x.tag in ("html", "body", "#page"):
        return False
    if x.hidden or x.tag in DROPPED or x.role in ROLES or x.words & READERS:
        return True
    if x.tag == "main" or not weak:
        return False
    return bool(x.words & (ADVERTS if x.tag == "article" else ADVERTS | AROUND))


def _articles(nodes: list[Node], marked: list[bool]) -> list[int]:
    """The elements that call themselves the article: articles within a main, else a main, else articles; none within what is marked or within each other."""
    n = len(nodes)
    out, in_main, in_article = [False] * n, [False] * n, [False] * n
    mains: list[int] = []
    own: list[int] = []
    of_main: list[int] = []
    for i in range(1, n):
        x, up = nodes[i], nodes[i].up
        out[i], in_main[i], in_article[i] = out[up] or marked[i], in_main[up], in_article[up]
        if out[i]:
            continue
        if x.tag == "main" or x.role == "main":
            if not in_main[i]:
                mains.append(i)
            in_main[i] = True
        elif (x.tag == "article" or x.role == "article" or x.body) and not in_article[i]:
            in_article[i] = True
            (of_main if in_main[i] else own).append(i)
    return of_main or mains or own


def _prose(nodes: list[Node], marked: list[bool]) -> list[int]:
    """The element with most text in paragraphs and the like of its own, links not counted; none where there is no such text."""
    prose, out = [0] * len(nodes), [False] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].up] or marked[i]
        if nodes[i].tag in PROSE and not out[i]:
            prose[nodes[i].up] += nodes[i].prose
    best = max(range(len(nodes)), key=lambda i: (prose[i], -i))
    return [best] if prose[best] else []


def read_main(text: str) -> Reading:
    """A page's subtrees and blocks, without the parts that say they are something other than the article.

    Where the page names its article, blocks outside it are left out, and of several articles all but the longest go where
    they recur. Else everything but the element with most prose goes where it recurs.
    """
    nodes, said = read_page(text)
    n = len(nodes)
    marked = [_named_other(x, True) for x in nodes]
    roots = _articles(nodes, marked)
    if not roots:  # words of a class may stand on what is around an article too
        firm = [_named_other(x, False) for x in nodes]
        roots = _articles(nodes, firm)
        for i in roots:
            while i > 0:
                marked[i], i = firm[i], nodes[i].up
    named = bool(roots)
    roots = roots or _prose(nodes, marked)
    size = lambda i: sum(len(b) for b, _ in said[nodes[i].first : nodes[i].last + 1])
    safe = max(roots, key=lambda i: (size(i), -i)) if roots else -1
    above, every = set(), set(roots)
    for i in roots:
        while i > 0:
            i = nodes[i].up
            above.add(i)
    taken, kept, gone = [not named] * n, [safe == 0] * n, [False] * n
    spans: list[tuple[int, int, int]] = []
    for i in range(1, n):
        x, up = nodes[i], nodes[i].up
        taken[i] = not named or taken[up] or i in every
        kept[i] = kept[up] or i == safe  # inside the article, kept even where it recurs
        site = not named and not kept[i] and i not in above and (x.tag == "header" or bool(x.words & SITE))
        gone[i] = gone[up] or marked[i] or site
        if x.parts and not kept[i] and i not in above:
            spans.append((x.digest, x.first, x.last))
    stays = [taken[at] and not gone[at] for _, at in said]
    before = [0]
    for s in stays:
        before.append(before[-1] + s)
    return Reading([(h, before[a], before[b + 1] - 1) for h, a, b in spans], [b for (b, _), s in zip(said, stays, strict=True) if s])


READ = "page_id long, url string, host string, subtrees array<struct<h:bigint,first:int,last:int>>, blocks array<string>"
_SUBTREES = pa.list_(pa.struct([("h", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), BATCH):
            part = batch.slice(start, BATCH)
            read = [read_main(t or "") for t in part.column("html").to_pylist()]
            trees = pa.array([[{"h": h, "first": a, "last": b} for h, a, b in r.subtrees] for r in read], _SUBTREES)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), trees, pa.array([r.blocks for r in read], pa.list_(pa.string()))], ["page_id", "url", "host", "subtrees", "blocks"])


def recurring(read: DataFrame) -> DataFrame:
    """(host, template): hashes of the subtrees on at least 3 pages and a hundredth of the pages of each host; addresses without a host have none.

    A host's list holds at most 100 times as many subtrees as its mean page, however many pages it has.
    """
    hosted = read.filter("host <> ''")
    pages = hosted.groupBy("host").agg(F.count("*").alias("pages"))
    counts = hosted.select("host", F.explode(F.array_distinct(F.transform("subtrees", lambda s: s["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    return counts.join(pages, "host").filter(F.col("n") >= F.col("pages") * SHARE).groupBy("host").agg(F.collect_list("h").alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) of every page; n_template counts its subtrees that are template and held text of its own choice.

    Character references are decoded once, white space of any kind within a block becomes one space, blocks are joined by
    one. A null or empty page has an empty text; a page cut off anywhere is read as far as it goes; pages are read whole.
    Repeated rows, null ids and null addresses are pages like others; further columns are not looked at. No pages, no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    read = materialize(rows.mapInArrow(_read, READ), "pages-read")
    template = materialize(recurring(read), "pages-template")
    # Where no block lies in a subtree that may go, nothing depends on other pages.
    open_ = F.exists("subtrees", lambda s: s["first"] <= s["last"])
    fixed, rest = read.filter(~open_).select("page_id", "url", "blocks"), read.filter(open_).join(template, "host", "left")
    hit = F.filter("subtrees", lambda s: (s["first"] <= s["last"]) & F.array_contains("template", s["h"]))
    rest = rest.withColumn("hit", F.when(F.col("template").isNull(), F.array().cast("array<struct<h:bigint,first:int,last:int>>")).otherwise(hit))
    left = F.filter("blocks", lambda b, i: ~F.exists("hit", lambda s: i.between(s["first"], s["last"])))
    out = fixed.withColumn("n_template", F.lit(0)).unionByName(rest.select("page_id", "url", left.alias("blocks"), F.size("hit").alias("n_template")))
    text = F.array_join("blocks", " ")
    return out.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), "n_template")
