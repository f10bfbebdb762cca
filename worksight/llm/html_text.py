"""Main text of HTML pages by minimum-cut labelling.

A page becomes text blocks, runs of text between block-level tags. A linear classifier over
text, links and enclosing elements gives each block the cost of taking it for content and
for boilerplate; these costs are terminal capacities of a flow network. Blocks that follow
one another, and blocks under one parent, are tied by smoothness edges, stronger the nearer
they stand in the document tree. The minimum cut, found by maximum flow, is the cheapest
labelling: a short sentence amid paragraphs stays, a long teaser amid links goes.

Every page is labelled by itself, in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import in_slices, text_or_empty

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?:(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<loose>[^>]*+)>)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"\b(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
    re.IGNORECASE,
)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements by their part in the page.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
SKIPPED = RAW | frozenset("head svg math canvas object select option datalist audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html
    legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr
    ul""".split()
)
CLOSES_ITSELF = {
    "li": {"ul", "ol", "menu", "dir"},
    "dt": {"dl"},
    "dd": {"dl"},
    "tr": {"table"},
    "td": {"tr", "table"},
    "th": {"tr", "table"},
}
BOILERPLATE = frozenset("nav aside footer form menu dialog button fieldset search".split())
CONTENT = frozenset(("article", "main"))

# Words of class names, ids and roles that mark boilerplate, comments and content.
BOILERPLATE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb
    breadcrumbs byline captcha contentinfo complementary cookie cookies consent copyright cta
    dialog disclaimer follow foot footer form gdpr header login masthead menu menubar modal
    nav navbar navigation newsletter notice notices notification alert outbrain overlay pager
    paginate pagination paywall popup popover privacy promo promoted promotion recommend
    recommended recommendations register related rail search share sharing shares sidebar
    sidebars side signup sitemap skip social sponsor sponsored sponsors subscribe
    subscription taboola tags teaser teasers toolbar topbar tracking trending widget
    widgets""".split()
)
# ... of these, words that a part of an article may be named for as well: they count against
# it, but a block of its own weight outweighs them.
WEAK_NAMES = frozenset(
    """follow header login notice notices promotion rail register related search share shares
    side skip social subscription tags tracking widget widgets""".split()
)
COMMENT_NAMES = frozenset(
    """comment comments commentlist commentary commenter disqus discussion feedback replies
    reply respond responses reviews ugc""".split()
)
CONTENT_NAMES = frozenset(
    "article articlebody body content entry main maincontent post story text".split()
)
_END = re.compile(r"[.!?…。！？:;][\"'”’»)]*$")
_LEGAL = re.compile(r"©|\(c\) ?\d{4}|all rights reserved|cookies?\b.*\b(?:use|accept|consent)", re.I)

CERTAIN = 40.0  # cost that no smoothness outweighs
DOUBTFUL = 4.0  # cost of a name that may mean either
ADJACENT = 0.5  # smoothness of blocks that follow one another, anywhere in the tree
SIBLING = 1.2  # ... of blocks under one parent
NEAR = 0.8  # ... of blocks one step apart, less for each further step


class Element:
    """An open or closed block element and what its names say."""

    __slots__ = (
        "comment", "content", "depth", "doubtful", "hidden", "holds_content", "marked", "parent", "tag"
    )

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.marked = self.doubtful = self.comment = self.hidden = False
        self.content = tag in CONTENT
        self.holds_content = False
        if tag in ("html", "body"):
            return
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden":
                self.hidden = True
            elif name == "style":
                self.hidden |= "display:none" in value.lower().replace(" ", "")
            else:
                parts = {part.lower() for part in _NAME_PART.findall(value)}
                self.marked |= not parts.isdisjoint(BOILERPLATE_NAMES - WEAK_NAMES)
                self.doubtful |= not parts.isdisjoint(WEAK_NAMES)
                self.comment |= not parts.isdisjoint(COMMENT_NAMES)
                self.content |= not parts.isdisjoint(CONTENT_NAMES)
        if self.content and (self.marked or self.doubtful or self.comment):
            self.content = tag in CONTENT  # "comment-text" is no content


class Block(NamedTuple):
    text: str
    words: int
    linked: float  # share of the letters that are in links
    element: Element
    heading: bool


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, without scripts, styles, forms' fields and markup."""
    found: list[Block] = []
    root = current = Element("html", "", None)
    pieces: list[str] = []
    linked = 0
    link: Element | None = None  # the element that the open link began in
    heading = False

    def finish() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                share = min(1.0, linked / len(text))
                found.append(Block(text, text.count(" ") + 1, share, current, heading))
            pieces.clear()
        linked = 0

    def close(element: Element) -> Element:
        return element.parent or root

    def still_open(link: Element | None) -> Element | None:
        """A link goes on through the blocks inside it, and ends with the block around it."""
        element = current if link is not None else None
        while element is not None and element is not link:
            element = element.parent
        return element

    at, n = 0, len(page)
    skipping: list[str] = []
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at and not skipping:
            text = html.unescape(page[at:start])  # a reference doesn't go on behind a tag
            pieces.append(text)
            if link is not None:
                linked += len(text.strip())
        if start == n:
            break
        match = _TOKEN.match(page, start)
        if not match:  # a bare "<"
            if not skipping:
                pieces.append("<")
            at = start + 1
            continue
        at = match.end()
        tag = match["tag"]
        if not tag:
            continue
        tag = tag.lower()
        attributes = match["attributes"] or match["loose"] or ""
        if match["end"]:
            if skipping:
                if tag in skipping:
                    while skipping.pop() != tag:
                        pass
                    if not skipping:
                        pieces.append(" ")
                continue
            if tag == "a":
                link = None
            if tag in BLOCKS or tag in BOILERPLATE:
                finish()
                element = current
                while element is not root and element.tag != tag:
                    element = close(element)
                if element is not root:
                    current = close(element)
                    link = still_open(link)
                heading = False
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
                if not end:
                    break
                close_at = page.find(">", end.start())
                at = n if close_at < 0 else close_at + 1
            if not skipping:
                pieces.append(" ")
            continue
        if skipping:
            if tag == "body" and "head" in skipping:
                skipping.clear()
            else:
                if tag in skipping and tag not in VOID and not attributes.endswith("/"):
                    skipping.append(tag)
                continue
        if tag in SKIPPED:
            if not attributes.endswith("/"):
                skipping.append(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr"):
                if tag == "hr":
                    finish()
                elif tag != "wbr":
                    pieces.append(" ")
            continue
        if tag == "a":
            link = current  # links don't nest
            continue
        if tag in BLOCKS or tag in BOILERPLATE:
            finish()
            closing = CLOSES_ITSELF.get(tag)
            if closing:
                element = current
                while element is not root and element.tag not in closing and element.tag != tag:
                    element = close(element)
                if element.tag == tag:
                    current = close(element)
            elif current.tag == "p" and tag in BLOCKS:
                current = close(current)
            link = still_open(link)
            if tag in ("html", "body"):
                continue
            current = Element(tag, attributes, current)
            if current.content:
                element = current.parent
                while element is not None and not element.holds_content:
                    element.holds_content = True
                    element = element.parent
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    finish()
    return found


def evidence(block: Block) -> float:
    """Log odds of the classifier that a block is content."""
    inside = named = doubtful = False
    element: Element | None = block.element
    while element is not None:
        if element.hidden or element.comment and not _has_main(element):
            return -CERTAIN
        in_article = element.tag in CONTENT
        if element.tag in BOILERPLATE and not _has_main(element):
            return -CERTAIN
        if element.tag == "header" and not _in_article(element) and not _has_main(element):
            return -CERTAIN
        if element.marked and not in_article and not _has_main(element):
            return -CERTAIN
        doubtful |= element.doubtful and not in_article and not _has_main(element)
        inside |= in_article
        named |= element.content
        element = element.parent
    score = -1.5 + min(3.0, block.words / 10) - 4.0 * block.linked
    score += 0.8 * bool(_END.search(block.text))
    score += 1.5 * block.heading
    score -= DOUBTFUL * doubtful
    score += 3.0 * inside + 1.5 * (named and not inside)
    score -= 3.0 * (not inside and bool(_LEGAL.search(block.text)))
    return score


def _has_main(element: Element) -> bool:
    """Layout boxes around the content are no boilerplate, whatever their names say."""
    return element.holds_content


def _in_article(element: Element) -> bool:
    parent = element.parent
    while parent is not None:
        if parent.tag in CONTENT:
            return True
        parent = parent.parent
    return False


def _steps(a: Element, b: Element) -> int:
    """Steps between two elements in the document tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        else:
            break
        steps += 1
    return steps


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in the page, and the next block under the same parent."""
    edges = []
    last_of: dict[int, int] = {}
    for k, block in enumerate(blocks):
        if k:
            steps = _steps(blocks[k - 1].element.parent or block.element, block.element.parent or block.element)
            edges.append((k - 1, k, SIBLING if not steps else ADJACENT + NEAR / (1 + steps)))
        parent = id(block.element.parent)
        before = last_of.get(parent)
        if before is not None and before < k - 1:
            edges.append((before, k, NEAR))
        last_of[parent] = k
    return edges


def minimum_cut(evidences: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut (Dinic's maximum flow).

    A node with evidence e > 0 has an arc of that capacity from the source, one with e < 0
    an arc of -e to the sink; ``edges`` are arcs of one capacity both ways.
    """
    n = len(evidences)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(to))
        to.append(b)
        room.append(forth)
        arcs[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, e in enumerate(evidences):
        if e > 0:
            arc(source, k, e, 0.0)
        elif e < 0:
            arc(k, sink, -e, 0.0)
    for a, b, weight in edges:
        arc(a, b, weight, weight)

    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for k in arcs[a]:
                if room[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[k] for k in path)
                for k in path:
                    room[k] -= flow
                    room[k ^ 1] += flow
                path.clear()
                a = source
                continue
            for place in range(following[a], len(arcs[a])):
                k = arcs[a][place]
                if room[k] > tiny and level[to[k]] == level[a] + 1:
                    following[a] = place
                    path.append(k)
                    a = to[k]
                    break
            else:
                following[a] = len(arcs[a])
                if a == source:
                    break
                level[a] = -2  # nothing gets on from here
                k = path.pop()
                a = to[k ^ 1]


def main_text(page: str) -> str:
    """The content blocks of a page, joined by an empty line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    labels = minimum_cut([evidence(block) for block in blocks], ties(blocks))
    return "\n\n".join(b.text for b, kept in zip(blocks, labels, strict=True) if kept)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Id, URL, text (empty if there is none) and n_chars of every page.

    A null page is empty; repeated rows give repeated rows; other columns are left out.
    Pages are read whole, whatever their length.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(text) for text in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        text_or_empty(F.col(html_col)).alias("html"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(extract, f"id {kind}, url string, text string, n_chars bigint")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})
