"""Main text of web pages by tag-path ratios.

A page is read as a row of text blocks, each with its path of tags from the root to the
leaf. Per path, the length of text and the punctuation of its blocks are added up and
divided by the number of its tags. These ratios are smoothed over neighbouring blocks in
page order, the two are fused into one score, and blocks over the mean of the page are content,
by their path's own ratios, or by the smoothed ones and half of the mean by their own. The article is the smallest element that holds
all of the content, with headings just before the content and what lies between; where
that is the whole body, only what lies from the first to the last content counts.

Parts that are never article text (navigation, forms, asides, footers, adverts, notices,
comments of readers and the like, by tag, role, class or id) are taken out before the scores
are made. A name takes out no heading, no element that holds an article or main element,
and "header" takes out nothing inside of those.

Rules of reading: a block element ends the block before it; comments, scripts, styles and
the head are skipped; character references are decoded; white space becomes one space;
an open paragraph ends where the next block element begins; unclosed elements end with
their parent; a page may be cut off anywhere.

Defined results: null or empty html gives an empty text; repeated rows get a row each; null
ids and urls stay null; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("head script style noscript template svg iframe canvas textarea select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
INLINE |= frozenset("math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle semantics annotation".split())
#: Parts of a page that are not its article.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
ARTICLE_TAGS = ("article", "main")
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar alertdialog".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|disqus|consent|cookies?\w*|copyright|disclaimer|footer|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|overlay|pagination|pager|popup|promo\w*|related\w*|recommend\w*|replies|reply|respond|search\w*|share|sharing|sidebar|signup|social\w*|sponsor\w*|subscribe|subscription|toolbar|widget)(?:$|[-_\s])",
    re.I,
)
_READERS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|replies|reply|respond)(?:$|[-_\s])", re.I)
_IN_ARTICLE = re.compile(r"(?:header|masthead)", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PUNCT = re.compile(r"[^\w\s]")
SMOOTH = 2
#: Part of the mean that a path must reach by itself where its neighbours lift it.
OWN = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FOLLOWERS = frozenset("ul ol dl table blockquote pre figure".split())


@dataclass(eq=False)
class Node:
    """An element; ``first`` and ``last`` number the blocks that it holds."""

    tag: str
    parent: Node | None
    path: int
    aside: bool = False
    named: Node | None = None
    readers: bool = False
    wraps: bool = False
    out: bool = False
    depth: int = 0
    in_article: bool = False
    heading: Node | None = None
    first: int = 0
    last: int = 0

    def holds(self, number: int) -> bool:
        return self.first <= number <= self.last


@dataclass(eq=False)
class Block:
    node: Node
    number: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    @property
    def aside(self) -> bool:
        return self.node.aside or (self.node.named is not None and self.node.named.out)


def _kinds(tag: str, attrs: str, parent: Node) -> tuple[bool, bool, bool]:
    """Whether an element is an aside by tag, role or style, whether by name, and whether the name is of readers' comments."""
    sure = tag in ASIDE_TAGS or (tag == "header" and not parent.in_article)
    named = readers = False
    for name, *values in _ATTR.findall(attrs) if attrs and tag not in ("html", "body", "main") else ():
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and tag not in HEADINGS:
            value = _IN_ARTICLE.sub("", value) if parent.in_article else value
            readers |= bool(_READERS.search(value))
            named |= readers if tag == "article" else bool(ASIDE_NAMES.search(value))
        sure |= name == "role" and value.lower() in ASIDE_ROLES and tag != "article"
        sure |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and bool(re.search(r"display\s*:\s*none", value, re.I)))
    return sure, named, readers


def read_blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order, with the element that each lies in."""
    root, paths = Node("", None, 0), {}
    node, blocks, at = root, [Block(root)], 0
    open_tags: Counter[str] = Counter()

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            blocks[-1].parts.append(raw)
            if node.tag == "a":
                blocks[-1].linked += len(raw)
        elif raw:
            blocks[-1].parts.append(" ")

    def block() -> None:
        if blocks[-1].parts:
            blocks.append(Block(node, len(blocks)))
        else:
            blocks[-1].node = node

    def close(outer: Node) -> Node:
        """End all open elements up to and with ``outer``."""
        now = node
        while now is not outer.parent:
            now.last = len(blocks) - (1 if blocks[-1].parts else 2)
            open_tags[now.tag] -= 1
            now = now.parent
        return now

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_tags[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            if tag not in INLINE:
                block()
        elif tag in VOID:
            if tag in ("br", "hr"):
                blocks[-1].parts.append(" ")
        elif tag in SKIPPED:
            end = re.compile(rf"</{re.escape(tag)}\s*>" if tag != "head" else r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            if tag not in INLINE and open_tags["p"] > 0:
                up = node  # a paragraph, and what stands open in it, ends here
                while up.tag in INLINE:
                    up = up.parent
                if up.tag == "p":
                    node = close(up)
            path = paths.setdefault((node.path, tag), len(paths) + 1)
            sure, named, readers = _kinds(tag, m[3] or m[6] or "", node)
            new = Node(tag, node, path, node.aside or sure, node.named, in_article=node.in_article or tag in ARTICLE_TAGS, heading=node.heading)
            new.depth = node.depth + 1
            if named:
                new.named, new.readers = new, readers
            if tag in ARTICLE_TAGS and not named:
                up = new.named
                while up is not None and not up.wraps:
                    up.wraps = True
                    up = up.parent.named
            if tag in HEADINGS:
                new.heading = new
            node = new
            open_tags[tag] += 1
            if tag not in INLINE:
                block()
            node.first = len(blocks) - 1
    text(page[at:])
    close(root)
    out = []
    for b in blocks:
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
        if b.text:
            out.append(b)
    judge_names(out)
    return out


def path_scores(blocks: list[Block], width: int = SMOOTH) -> np.ndarray:
    """The smoothed and fused tag-path ratios of each block: of text length and of punctuation; not smoothed for width 0."""
    size, marks, count = {}, {}, {}
    for b in blocks:
        p = b.node.path
        plain = len(b.text) - min(len(b.text), b.linked)
        size[p] = size.get(p, 0) + plain
        marks[p] = marks.get(p, 0) + len(_PUNCT.findall(b.text)) * (plain > 0)
        count[p] = count.get(p, 0) + 1
    kernel = np.exp(-(np.arange(-width, width + 1) ** 2) / 2.0)

    def smooth(x: np.ndarray) -> np.ndarray:
        weight = np.convolve(np.ones(len(x)), kernel)[width : width + len(x)]
        return np.convolve(x, kernel)[width : width + len(x)] / weight

    length = smooth(np.array([size[b.node.path] / count[b.node.path] for b in blocks]))
    punct = smooth(np.array([marks[b.node.path] / count[b.node.path] for b in blocks]))
    return np.sqrt(length * (1.0 + punct))


def judge_names(blocks: list[Block]) -> None:
    """Which named elements are out, with all in them: those whose name is not overruled by what they hold, and what lies in such."""
    size, seen, total = Counter(), set(), 0
    for b in blocks:
        named = b.node.named
        if not b.node.aside:
            plain = len(b.text) - min(len(b.text), b.linked)
            total += plain
            size[named] += plain
        while named is not None and named not in seen:
            seen.add(named)
            named = named.parent.named
    inner_first = sorted(seen, key=lambda n: -n.depth)
    for n in inner_first:
        size[n.parent.named] += size[n]
    marked = any(b.node.in_article and not b.node.aside for b in blocks)  # short articles stand beside long other parts
    for n in reversed(inner_first):
        n.wraps |= 2 * size[n] > total and not n.readers and not marked
        n.out = not n.wraps or (n.parent.named is not None and n.parent.named.out)


def followers(fit: list[Block], last: Block) -> list[Block]:
    """Lists, tables and the like right behind ``last``, under the parent of its element."""
    out, parent = [], last.node.parent
    for b in fit:
        if b.number <= last.number:
            continue
        up = b.node
        while up is not None and up.parent is not parent:
            up = up.parent
        if up is None or up.tag not in FOLLOWERS or 2 * b.linked > len(b.text):
            break
        out.append(b)
    return out


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the article: see the module's text."""
    fit = [b for b in blocks if not b.aside]
    if not fit:
        return []
    score, own = path_scores(fit), path_scores(fit, 0)
    over = (own >= own.mean() * 0.999) | ((score >= score.mean() * 0.999) & (own >= own.mean() * OWN))
    content = [b for b, c in zip(fit, over, strict=True) if c]
    low, high = content[0].number, content[-1].number
    article = content[0].node
    while article.parent and not (article.holds(low) and article.holds(high)) or article.tag in INLINE or article.tag in HEADINGS or article.tag == "p":
        article = article.parent
    if sum(article.holds(b.number) for b in fit) == 1 and article.tag not in ("", "html", "body", *ARTICLE_TAGS) and article.parent.tag not in ("", "html", "body"):
        article = article.parent
    if article.tag in ("", "html", "body"):
        more = followers(fit, content[-1])
        high = more[-1].number if more else high
        inside = [low <= b.number <= high for b in fit]
    else:
        inside = [article.holds(b.number) for b in fit]
        low = article.first
    first = start = inside.index(True)
    for k in range(first - 1, -1, -1):
        if 2 * fit[k].linked > len(fit[k].text):
            break
        heading = fit[k].node.heading
        if heading and heading.parent.first <= low and heading.parent.holds(low):
            start = k
    return [b for k, (b, x) in enumerate(zip(fit, inside, strict=True)) if start <= k < first or x]


def extract(page: str | None) -> str:
    return " ".join(b.text for b in main_blocks(read_blocks(page))) if page else ""


def extract_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices(batch.column(2)):
            texts = [extract(x) for x in batch.column(2).slice(low, high - low).to_pylist()]
            n = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in (0, 1)), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(extract_pages, "page_id long, url string, text string, n_chars long")
