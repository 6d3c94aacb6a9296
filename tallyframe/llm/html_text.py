"""Main text of web pages by composite text density.

A page becomes a tree without what elements, roles and styles themselves say is no text (scripts, forms, navigation). For
every node left, the characters for each tag are adjusted by those in links (:func:`composite_density`); a node's density
sum adds up those of its children. The node with the largest sum is the core of the article. On its path to the body the
branches beside it stay where they are at least as dense as the body-path threshold, the least density on that path, and not
mostly links. Within the article that holds the core (its element, or the box around it) short blocks are the article's as
well, so there only branches that are mostly links go. Last, within what density has left, boxes go whose class or id names
something that is not the article (an advert between paragraphs, reader comments below them). The blocks of the rest are the text.

Defined results: a null or empty page, or one without text, gives an empty text; mark-up that is cut
off, unclosed or wrongly nested is repaired as browsers do; text without any mark-up is one block;
a null id or url is passed on; equal rows give equal results; further columns stay out of the way.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CUT = frozenset(
    "head title script style noscript template iframe svg canvas object embed applet audio video nav footer aside form button input select textarea "
    "dialog menu map datalist noembed noframes fieldset meter progress".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words that name what is not the article.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr "
    "notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside rail widget widgets menu menus nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer copyright comment comments commentlist disqus reply replies "
    "respond discussion share sharing social related recommended recommendations trending popular skip disclaimer".split()
)
#: Words that may stand beside those in a class or id: place, kind of box, number.
PLACE_WORDS = frozenset(
    "site page global top bottom left right side primary secondary tertiary sub inner outer first second last big small large mini sticky fixed floating "
    "area bar block body box buttons button card cards column columns container content cta form group icons inline item items label leaderboard link links list "
    "module news panel posts region row section slot space strip tags text title unit units wrap wrapper zone to us by of the and for one two".split()
)
#: Elements whose class and id say nothing about themselves.
TRUSTED = frozenset("html body main article".split())
#: Start tags that end an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an implied end does not reach beyond.
SCOPES = frozenset("html body table td th caption button object ul ol dl article section div main blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an end tag does not reach beyond, and the names of those that do.
WALLS = frozenset("td th table body article main".split())
BREAKERS = frozenset("table tr tbody body html article main div section ul ol".split())
#: Elements of drawings that close themselves.
DRAWN = frozenset("path g rect circle use".split())
#: Elements of text, cut by class only if the whole of it names what is not the article.
PLAIN = HEADINGS | frozenset("p li dd dt blockquote pre td th span a b i em strong".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"<]*\"|'[^'<]*')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LETTER = re.compile("[a-zA-Z]")
_EMPTY_COMMENT, _COMMENT_CLOSED = re.compile("<!---?>"), re.compile("--!?>")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("name", "parent", "children", "attributes", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Element | None, attributes: str = ""):
        self.name, self.parent, self.attributes = name, parent, attributes
        self.children: list[Element | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def values(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)} if "=" in self.attributes else {}


def _comment_end(html: str, start: int) -> int:
    """Where a comment that begins there ends, by the rules of HTML; -1 if it does not. What is no true comment ends with its first ``>``."""
    if html.startswith("<!--", start):
        m = _EMPTY_COMMENT.match(html, start) or _COMMENT_CLOSED.search(html, start + 4)
        return m.end() if m else -1
    end = html.find(">", start + 2)
    return end + 1 if end >= 0 else -1


def _marks(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(text, name, attributes, end) of a page: the text before each tag, its name (with a slash where it ends), where it ends.

    Comments and declarations (also those for XML) are passed over; one that is never closed, and a tag that is cut off, end the page.
    The caller may send a place to go on from.
    """
    at, parts = 0, []
    while (start := html.find("<", at)) >= 0:
        parts.append(html[at:start])
        following = html[start + 1 : start + 2]
        if following in ("!", "?") or following == "/" and start + 2 < len(html) and not _LETTER.match(html, start + 2):
            end = _comment_end(html, start)
            if end < 0:
                at = len(html)
                break
            at = end
        elif _LETTER.match(html, start + 1) or following == "/" and _LETTER.match(html, start + 2):
            m = _TAG.match(html, start) or _LOOSE_TAG.match(html, start)
            if m is None:
                at = len(html)
                break
            at = (yield "".join(parts), m[1] + m[2].lower(), m[3], m.end()) or m.end()
            parts = []
        else:
            parts.append("<")
            at = start + 1
    parts.append(html[at:])
    yield "".join(parts), "", "", len(html)


class _Tree:
    """A tree under construction: the element that is open, and how many of each name are."""

    def __init__(self):
        self.root = self.now = Element("#root", None)
        self.open: Counter[str] = Counter()

    def leave(self, node: Element) -> None:
        """Close all up to that element, it included."""
        while self.now is not node:
            self.open[self.now.name] -= 1
            self.now = self.now.parent
        self.open[node.name] -= 1
        self.now = node.parent

    def begin(self, name: str, attributes: str) -> Element:
        self._end_implied(name)
        child = Element(name, self.now, attributes)
        self.now.children.append(child)
        return child

    def enter(self, child: Element) -> None:
        self.open[child.name] += 1
        self.now = child

    def end(self, name: str) -> None:
        """An end tag: closes the element it names, unless cells, tables or the article stand between."""
        if self.open[name]:
            node = self.now
            while node.name != name:
                if node.name in WALLS and name not in BREAKERS:
                    return
                node = node.parent
            self.leave(node)
        elif name in ("p", "br"):
            self.now.children.append(Element(name, self.now))

    def _end_implied(self, name: str) -> None:
        """Close what a start tag ends: an open paragraph or heading, or an element of a list, table or menu."""
        if name in BLOCKS and (self.open["p"] or name in HEADINGS and any(self.open[h] for h in HEADINGS)):
            node = self.now
            while node.parent is not None and node.name not in SCOPES:
                if node.name == "p" or node.name in HEADINGS and name in HEADINGS:
                    self.leave(node)
                    break
                node = node.parent
        ends = CLOSES.get(name, frozenset())
        if any(self.open[n] for n in ends):
            node = self.now
            while node.parent is not None:
                if node.name in ends:
                    self.leave(node)
                    if name != "tr" or node.name == "tr":
                        break
                    node = self.now
                    continue
                if node.name in SCOPES:
                    break
                node = node.parent


def parse(html: str) -> Element:
    """The tree of a page. Unclosed, wrongly nested and cut-off mark-up is repaired."""
    tree, marks = _Tree(), _marks(html)
    step = next(marks)
    while True:
        text, name, attributes, end = step
        if text:
            tree.now.children.append(unescape(text) if "&" in text else text)
        if not name:
            return tree.root
        go_on = None
        if name[0] == "/":
            tree.end(name[1:])
        else:
            child = tree.begin(name, attributes)
            if name in RAW:
                closing = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, end)
                inside = html[end : closing.start() if closing else len(html)]
                if name in ("textarea", "title"):
                    child.children.append(unescape(inside))
                go_on = closing.end() if closing else len(html)
            elif name not in VOID and not (attributes.endswith("/") and name in DRAWN):
                tree.enter(child)
        step = marks.send(go_on) if go_on is not None else next(marks)


def _names_other(token: str, plain: bool = False) -> bool:
    """Whether all of a class or id names something that is not the article: one such word, or several with words of place.

    ``plain`` tells of an element of text, where only the bare word counts.
    """
    words = [w.lower() for w in _WORDS.findall(token)]
    if plain or len(words) == 1:
        return len(words) == 1 and words[0] in CUT_WORDS
    return any(w in CUT_WORDS for w in words) and all(w in CUT_WORDS or w in PLACE_WORDS for w in words)


def _cut_by_itself(node: Element, in_article: bool) -> bool:
    """Whether an element, its role or its style say that it holds no text of an article."""
    if node.name in CUT:
        return True
    if not node.attributes:
        return node.name == "header" and not in_article
    values = node.values()
    if "hidden" in re.split(r"[\s=]", node.attributes.lower()) or values.get("aria-hidden") == "true" or _HIDDEN.search(values.get("style", "")):
        return True
    return values.get("role", "").lower() in CUT_ROLES or node.name == "header" and not in_article


def prune(root: Element) -> None:
    """Cut what elements, roles and styles say is no text of an article; of a header within one, the headings stay."""
    stack: list[tuple[Element, bool, bool]] = [(root, False, False)]
    while stack:
        node, in_article, in_header = stack.pop()
        kept: list[Element | str] = []
        for c in node.children:
            if isinstance(c, str):
                if not in_header or node.name in HEADINGS or _inside_heading(node):
                    kept.append(c)
            elif not _cut_by_itself(c, in_article):
                kept.append(c)
                stack.append((c, in_article or c.name in ("article", "main"), in_header or c.name == "header"))
        node.children = kept


def _named_other(node: Element) -> bool:
    if node.name in TRUSTED and node.name != "article" or not node.attributes:
        return False
    values = node.values()
    return any(_names_other(t, node.name in PLAIN) for t in f"{values.get('class', '')} {values.get('id', '')}".split())


def _holders(root: Element) -> set[Element]:
    """The elements around an article, if the page names one."""
    found: set[Element] = set()
    for n in _order(root):
        if n.name == "main" or n.name == "article" and not _named_other(n):
            while (n := n.parent) is not None and n not in found:
                found.add(n)
    return found


def _misled(best: Element, holders: set[Element]) -> Element | None:
    """The box that names itself no article in which the densest text stands, though the page has an article elsewhere."""
    box = None
    while best.parent is not None and holders:
        if best.name in ("article", "main") and not _named_other(best):
            return None
        if best not in holders and _named_other(best):
            box = best
        best = best.parent
    return box


def drop_named(top: Element, path: set[Element], holders: set[Element]) -> None:
    """Cut boxes within what density has left whose names say that they are not the article's.

    What holds the article stays; so do the path to the core and a box with most of the text, unless the article is elsewhere.
    """
    stack = [(top, False)]
    while stack:
        node, in_article = stack.pop()
        inside = in_article or node.name in ("article", "main")
        sure = inside or not holders
        node.children = [c for c in node.children if isinstance(c, str) or c in holders or sure and (c in path or c.chars * 2 > top.chars) or not _named_other(c)]
        stack.extend((c, inside) for c in node.children if isinstance(c, Element))


def _inside_heading(node: Element) -> bool:
    while node is not None:
        if node.name in HEADINGS:
            return True
        node = node.parent
    return False


def _order(root: Element) -> list[Element]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Element))
    return order


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_link_chars: int) -> float:
    """Characters for each tag, weighed down the more of them stand in links (Sun, Song and Liao, 2011)."""
    if not chars:
        return 0.0
    tags, link_tags, links = max(tags, 1), max(link_tags, 1), max(link_chars, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_link_chars / max(body_chars, 1) * chars + math.e)
    return chars / tags * math.log(max(chars / links * tags / link_tags, 1.0) + 1e-9) / base if base else 0.0


def measure(root: Element) -> list[Element]:
    order = _order(root)
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.name == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.name == "a")
    body = next((n for n in order if n.name == "body"), root)
    for node in order:
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, body.chars, body.link_chars)
    for node in reversed(order):
        node.total = sum(c.density for c in node.children if isinstance(c, Element) and _is_block(c))
    return order


def _is_block(node: Element) -> bool:
    """Whether a node counts in density sums: marks within a line do not, unless they hold blocks."""
    return node.name in BLOCKS or node.total > 0


def core(root: Element, holders: set[Element]) -> tuple[Element, list[Element]]:
    """The body without the branches that are not the article's, and the path from the core to it."""
    while True:
        order = measure(root)
        best = max((n for n in order if n.chars and _is_block(n)), key=lambda n: (n.total, n.density), default=root)
        box = _misled(best, holders)
        if box is None:
            break
        box.parent.children.remove(box)
    body = next((n for n in order if n.name == "body"), root)
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    holder = next((i for i, n in enumerate(path) if n.name == "article"), None)
    if holder is None:
        holder = next((i for i, n in enumerate(path) if n.name == "main"), min(1, len(path) - 1) if path[-1] is not best else 0)
    for i, (chosen, parent) in enumerate(zip(path[:-1], path[1:], strict=True)):
        own_text = any(isinstance(c, str) and c.strip() for c in parent.children)
        at = next(k for k, c in enumerate(parent.children) if c is chosen)
        inside = i < holder and parent is not body
        parent.children = [c for k, c in enumerate(parent.children) if c is chosen or isinstance(c, str) or _belongs(c, threshold, own_text, k < at, inside)]
    return path[-1], path


def _belongs(side: Element, threshold: float, in_text: bool, before: bool, inside: bool) -> bool:
    """Whether a branch beside the path to the core is the article's; ``inside`` the article's own box short blocks are, too."""
    if in_text and side.name not in BLOCKS:
        return True
    if before and (side.name in HEADINGS or side.name in ("header", "hgroup") and side.chars):
        return True
    return (inside or side.density >= threshold) and side.link_chars * 2 <= side.chars


def blocks(node: Element) -> Iterator[str]:
    """Texts of the blocks under a node in page order, white space in each turned into single spaces."""
    parts: list[str] = []
    stack: list[Element | str | None] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item is None or item.name in BLOCKS:
            text = " ".join("".join(parts).split())
            parts = []
            if text:
                yield text
            if item is not None:
                stack.append(None)
                stack.extend(reversed(item.children))
        elif item.name == "br":
            parts.append(" ")
        else:
            stack.extend(reversed(item.children))
    text = " ".join("".join(parts).split())
    if text:
        yield text


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    prune(root)
    holders = _holders(root)
    top, path = core(root, holders)
    drop_named(top, set(path), holders)
    return "\n\n".join(blocks(top))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        pages = batch.column("html")
        texts = [main_text(pages[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
