"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text.  For each root-to-leaf tag path
the text length and punctuation of its nodes are summed and divided by the
number of nodes on the path; both ratios are smoothed over the paths in page
order, fused (their product), and the paths above a threshold (a share of the
page's standard deviation) are content.  The smallest element that holds most
of the content text is the article; its blocks are the result, without those
that stand in parts marked as something else (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, scripts and styles).  Content
blocks outside of the article belong to the result too, with their headings,
unless a main part that holds most of the content leaves them out.  A
class, an id or a form that holds the page's content marks nothing.

Defined results: null or empty html, and pages without text, give the empty
text; markup that never closes is closed where its parent or the page ends;
repeated rows give the same text each.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.tokens import text_chunks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# their content is text, not markup
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title noscript template iframe noembed noframes head svg math object canvas audio video "
                   "select option datalist textarea button".split())
ASIDE = frozenset("nav footer aside menu dialog".split()) | UNSEEN
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
# an element that one of these starts also ends an open paragraph
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# words of class, id and role that name parts beside the article
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side aside rail widget widgets footer foot copyright "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social comment comments commentlist respond reply replies disqus discussion related recommended "
    "recommendations trending pagination pager tags skip search".split())
# those that also name parts of an article
SOFT_WORDS = frozenset("notice notices alert share sharing side banner banners related discussion respond reply tags search".split())
# a class or id with one of these tells the state of a page, not what a part is
STATE_WORDS = frozenset("has with without no open opened closed collapsed enabled disabled".split())
ARTICLE_WORDS = frozenset("article content main body post entry story text".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("ul ol dl table body html div section article main select".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?、。，；：！？]")


@dataclass(slots=True)
class Element:
    name: str
    parent: Element | None
    path: str
    side: bool      # this and the next two hold for all that stands inside
    article: bool
    link: bool
    number: int
    own: float = 0.0  # content text inside
    holder: Element | None = None  # the nearest element that isn't inline
    marks: frozenset[str] | None = None  # if its class or id may name a side part: the words; a form has its name
    marker: Element | None = None  # the nearest such element, itself or around
    ignored: bool = False  # the page's text stands inside: the marks don't hold


@dataclass(slots=True)
class Node:
    """A block of text: its element, its pieces, and how much of it is linked."""

    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    side: bool = False
    marker: Element | None = None

    def aside(self) -> bool:
        m = self.marker
        while m is not None and m.ignored:
            m = m.parent.marker
        return self.side or m is not None


def blocks(page: str) -> tuple[list[Node], list[Element]]:
    """Text blocks in page order, and all elements."""
    root = Element("", None, "", False, False, False, 0)
    root.holder = root
    elements, stack, out = [root], [root], []
    node: Node | None = None
    at, n = 0, len(page)

    def text(raw: str) -> None:
        nonlocal node
        if not raw:
            return
        top = stack[-1]
        holder, side = top.holder, top.side
        if node is None or node.element is not holder or node.side != side or node.marker is not top.marker:
            if node is not None and node.element is holder and not raw.strip():
                return
            node = Node(holder, side=side, marker=top.marker)
            out.append(node)
        if "&" in raw:
            raw = entities.unescape(raw)
        node.parts.append(raw)
        if top.link:
            node.linked += len(raw.strip())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = TAG.match(page, lt)
        if m is None:  # a lone "<" is text
            nxt = page.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            text(page[at:nxt])
            at = nxt
            continue
        text(page[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if any(e.name == name for e in stack[1:]):
                # an inline end tag doesn't reach beyond the block it stands in
                k = max(i for i, e in enumerate(stack) if e.name == name)
                if name in INLINE and any(e.name not in INLINE for e in stack[k + 1:]):
                    continue
                del stack[k:]
                if name not in INLINE:
                    node = None
            elif name == "p":
                node = None
            continue
        if name in ("br", "hr"):
            if node is not None:
                node.parts.append(" ")
            if name == "hr":
                node = None
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            node = None
            if name in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in BLOCKS:
                        break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in CLOSES.get(name, ()):
                    del stack[k:]
                    break
                if stack[k].name in SCOPE:
                    break
        words: set[str] = set()
        hidden = False
        marked = ""
        for a in ATTR.finditer(m[3]) if m[3] else ():
            value = (a[2] or a[3] or a[4] or "").lower()
            key = a[1].lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                hidden = True
            elif key == "role":
                hidden |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form")
            else:
                for token in value.split():
                    found = WORD.findall(token)
                    if STATE_WORDS.isdisjoint(found):
                        words.update(found)
                marked += "." + value.replace(" ", ".")
        parent = stack[-1]
        side = parent.side or hidden or name in ASIDE or (name == "header" and not parent.article)
        e = Element(name, parent, f"{parent.path}/{name}{marked}", side, parent.article or name in ("article", "main"),
                    parent.link or name == "a", len(elements))
        e.holder = parent.holder if name in INLINE else e
        side_words = words & SIDE_WORDS
        if name == "form":
            side_words.add(name)
        if side_words and name not in ("html", "body", "main"):
            e.marks = frozenset(side_words)
        e.marker = e if e.marks and name != "article" else parent.marker
        elements.append(e)
        if m[3].rstrip().endswith("/") and name in ("svg", "path", "use", "rect", "circle"):
            continue
        if name in RAW and name != "noscript":
            end = re.compile(rf"</{name}\s*/?>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        stack.append(e)
    return out, elements


def smooth(x: np.ndarray, radius: int = 1) -> np.ndarray:
    """Gaussian smoothing over neighbouring paths."""
    if len(x) < 2:
        return x
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius, 1) * 1.5) ** 2)
    padded = np.pad(x, radius, mode="edge")
    return np.convolve(padded, w / w.sum(), mode="valid")


def content_paths(seen: list[tuple[Node, str]], sides: list[bool], share: float) -> set[str]:
    """The tag paths whose fused ratio passes the threshold."""
    # sums by tag path, in the order in which the paths appear
    paths: dict[str, list[float]] = {}
    for (b, t), side in zip(seen, sides):
        p = paths.setdefault(b.element.path, [0, 0, 0])
        p[0] += 1
        p[1] += 0 if side else max(len(t) - b.linked, 0)
        p[2] += 0 if side else len(PUNCTUATION.findall(t))
    table = np.array(list(paths.values()), float)
    length = smooth(table[:, 1] / table[:, 0])
    points = smooth(table[:, 2] / table[:, 0] + 1)
    fused = length * points
    limit = share * fused.std()
    return {p for p, f, row in zip(paths, fused, table) if f >= limit and row[1] > 0}


def weigh_marks(seen: list[tuple[Node, str]], elements: list[Element], share: float) -> None:
    """Ignore the marks of elements that hold the page's content: those with its main part,
    heading or only article and more content than the unmarked rest, or with nearly all of it
    where the rest has no such element; and of parts of an article under an ambiguous name
    whose text is content."""
    content = content_paths(seen, [b.side for b, _ in seen], share)
    unmarked = content_paths(seen, [b.aside() for b, _ in seen], share)  # not measured by what is marked
    inner: dict[int, float] = {}   # content without other marks, by its marked element
    whole: dict[int, float] = {}   # all text
    clean = 0.0
    for b, t in seen:
        if b.side:
            continue
        weight = max(len(t) - b.linked, 0) if b.element.path in (unmarked if b.marker is None else content) else 0
        if b.marker is None:
            clean += weight
        else:
            inner[b.marker.number] = inner.get(b.marker.number, 0) + weight
            whole[b.marker.number] = whole.get(b.marker.number, 0) + len(t)
    holds: dict[int, list[int]] = {}  # main parts and headings, articles
    plain = False
    for e in elements:
        if not e.side and (e.name in ("main", "h1") or (e.name == "article" and not e.marks)):
            m = e.marker
            plain |= m is None
            while m is not None:
                holds.setdefault(m.number, [0, 0])[e.name == "article"] += 1
                m = m.parent.marker
    for number, weight in inner.items():
        e = elements[number]
        main, articles = holds.get(number, (0, 0))
        if (weight > clean and (main or articles == 1)) or not clean or (not plain and clean < 0.1 * weight):
            m = e  # with the marked elements around it
            while m is not None:
                m.ignored = True
                m = m.parent.marker
        elif e.article and e.marks <= SOFT_WORDS and weight >= 0.5 * whole[number]:
            e.ignored = True


def main_text(page: str | None, share: float = 0.3) -> str:
    """The article's text of one page."""
    if not page:
        return ""
    nodes, elements = blocks(page)
    texts = [SPACES.sub(" ", "".join(b.parts)).strip() for b in nodes]
    seen = [(b, t) for b, t in zip(nodes, texts) if t]
    if not seen:
        return ""
    if any(b.marker is not None for b, _ in seen):
        weigh_marks(seen, elements, share)
    sides = [b.aside() for b, _ in seen]
    content = content_paths(seen, sides, share)
    if not content:  # marks alone never leave a page without text
        sides = [b.side for b, _ in seen]
        content = content_paths(seen, sides, share)
    # the deepest element that holds most of the content text
    total = 0.0
    for (b, t), side in zip(seen, sides):
        if not side and b.element.path in content:
            weight = max(len(t) - b.linked, 0)
            total += weight
            e = b.element
            while e is not None:
                e.own += weight
                e = e.parent
    if not total:
        return ""
    holders = {}
    for b, _ in seen:
        e = b.element
        while e is not None:
            holders[e.number] = e
            e = e.parent
    marked = [e for e in holders.values() if e.own >= 0.5 * total
              and (e.name in ("article", "main") or set(WORD.findall(e.path.rsplit("/", 1)[-1].partition(".")[2])) & ARTICLE_WORDS)]
    article = max(marked, key=lambda e: (e.name == "article", e.own, e.number)) if marked else max(
        (e for e in holders.values() if e.own >= 0.9 * total), key=lambda e: e.number)
    if article.name in ("p", "pre", "blockquote") and article.parent is not None:
        article = article.parent

    # a main part that holds most of the content bounds it
    bound = max((e for e in holders.values() if e.name == "main" and e.own >= 0.5 * total), key=lambda e: e.own, default=None)

    def inside(e: Element | None, part: Element) -> bool:
        while e is not None:
            if e is part:
                return True
            e = e.parent
        return False

    # content beside the article isn't lost: its nodes, and the headings that stand right before them
    out, follows = [], False
    for (b, t), side in reversed(list(zip(seen, sides))):
        if side:
            continue
        own = b.element.path in content and 2 * b.linked < len(t) and (bound is None or inside(b.element, bound))
        heading = follows and b.element.name in ("h1", "h2", "h3", "h4", "h5", "h6")
        follows = own or heading
        if follows or inside(b.element, article):
            out.append(t)
    return " ".join(reversed(out))


def extract(pages: DataFrame, share: float = 0.3) -> DataFrame:
    """page_id, url, text, n_chars of ``pages`` (page_id, url, html)."""

    def run(batches):
        for part, whole in text_chunks(batches, column="html"):
            texts = [main_text(x, share) for x in whole]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
