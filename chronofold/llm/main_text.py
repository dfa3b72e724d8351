"""Main text of pages by tree scoring.

A page is read into a tree with the end tags that HTML lets authors leave out. Chrome goes first: by
element (menus, asides, forms, scripts), by role, by class and id names, and what is hidden. Then every
paragraph scores a point, one more for each comma and one for each 100 characters (three at most), and
passes all of it to its parent, half to its grandparent, and a third of that divided by the distance
further up. A container's points, with a bonus for what it is and is called, are discounted by its
link density. The best container is kept, with those of its siblings that score a fifth of it, are
made like it or read like prose; if it is part of an article or main element, that is kept whole. In what is kept, lists and boxes that mostly consist of links go.

The text has one line a block, in page order: character references decoded, white space turned into
one blank, nothing cut.

Cases: a null or empty page, and one without text outside chrome, gives an empty text; a page without
markup is its own text; unclosed and crossing tags follow the rules below; very long pages are read
whole, in time proportional to their length, one at a time; rows that repeat are extracted each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset(
    "head title script style noscript template nav aside footer form button select option textarea input label fieldset dialog iframe object embed"
    " canvas svg audio video map menu search datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status tablist".split())
# Parts of class and id names, in lower case; a name is cut at signs and at capitals.
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner billboard sponsor sponsored sponsors promo promoted promotion"
    " nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets rail header masthead topbar toolbar footer colophon"
    " notice notices cookie cookies consent gdpr alert popup modal overlay lightbox toast newsletter subscribe subscription signup login paywall"
    " comment comments commentlist disqus respond reply replies discussion form search share sharing social related recommended recommendations"
    " teaser teasers pagination pager copyright legal disclaimer outbrain taboola skip hidden".split()
)
NEGATIONS = frozenset("no has with without is not".split())  # `has-sidebar` says something about a page, not of a sidebar
CONTENT_NAMES = frozenset("article articlebody body content entry hentry main page post story text blog".split())
TRUSTED = frozenset("html body main".split())  # never chrome by their names
NO_ARTICLE = frozenset("ad ads advert sponsored promo comment comments reply respond related recommended teaser teasers notice widget".split())
HEAD = frozenset("title script style meta link base noscript template".split())
LEVELS = 5  # ancestors that a paragraph's points reach
WORTH = {"article": 25, "main": 15, "section": 3, "div": 5, "blockquote": 3, "pre": 3, "td": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3, "th": -5}
PARAGRAPHS = frozenset("p pre blockquote td li dd dt figcaption h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SENTENCE = re.compile(r"[.!?]\s*$")
COMMAS = re.compile("[,،、，]")

# An opening tag ends these elements where they are open, up to the nearest of the borders.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
        "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
BORDERS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}
TABLE = frozenset({"table"})
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")


class Node:
    __slots__ = ("chrome", "length", "links", "names", "parts", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None, names: tuple[str, ...] = (), chrome: bool = False):
        self.tag, self.parent, self.names, self.chrome = tag, parent, names, chrome
        self.parts: list[Node | str] = []
        self.points = 0.0
        self.length = self.links = 0  # characters of text below, and of that in links


def name_parts(attributes: dict[str, str | None]) -> tuple[str, ...]:
    """Parts of the class and id names; names that begin with a negation, and modifiers after two signs, say nothing."""
    parts = []
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        own = [p.lower() for p in CAMEL.split(name.split("--")[0]) if p]
        if own and own[0] not in NEGATIONS:
            parts.extend(own)
    return tuple(parts)


def is_chrome(tag: str, attributes: dict[str, str | None], names: tuple[str, ...], inside: bool) -> bool:
    """Whether an element is chrome. inside: in an article, whose own header has its title."""
    if tag in TRUSTED:
        return False
    hidden = "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true"
    hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style") or "", re.IGNORECASE) is not None
    if hidden or tag in CHROME or (attributes.get("role") or "").lower() in ROLES:
        return True
    if tag in HEADINGS:
        return False
    if tag == "article":
        return not NO_ARTICLE.isdisjoint(names)
    titles = inside and (tag == "header" or "header" in names)
    return (tag == "header" and not inside) or any(n in CHROME_NAMES and not (titles and n == "header") for n in names)


class Tree(HTMLParser):
    """The tree of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("html", None)
        self.open: dict[str, int] = {}

    def _push(self, node: Node) -> None:
        self.now.parts.append(node)
        self.now = node
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def _pop(self) -> None:
        self.open[self.now.tag] -= 1
        self.now = self.now.parent

    def _close(self, tags: set[str], borders: frozenset[str] | set[str]) -> None:
        """Ends the outermost open element of `tags` on this side of the borders, with what is open inside."""
        if not any(self.open.get(t) for t in tags):
            return
        node, last = self.now, None
        while node is not self.root and node.tag not in borders:
            last = node if node.tag in tags else last
            node = node.parent
        while last is not None and self.now is not last.parent:
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in BLOCKS:
            self._close({"p"}, {"button", "table", "td", "th", "caption", "object"})
        if tag in HEADINGS and self.now.tag in HEADINGS:
            self._pop()
        if tag in ENDS:
            self._close(ENDS[tag], BORDERS.get(tag, TABLE))
        if self.open.get("head") and tag not in HEAD and not self.open.get("noscript") and not self.open.get("template"):
            self._close({"head"}, frozenset())
        if tag == "a":
            self._close({"a"}, BLOCKS)
        attributes = dict(attrs)
        names = name_parts(attributes)
        inside = bool(self.open.get("article") or self.open.get("main"))
        node = Node(tag, self.now, names, is_chrome(tag, attributes, names, inside))
        if tag in VOID:
            self.now.parts.append(node)
        else:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML, except in drawings, which go anyway

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.now.parts.append(Node(tag, self.now))
        if not self.open.get(tag):
            return
        # An inline element's end doesn't reach beyond a block; a block's end doesn't leave a table's cell.
        borders = {"td", "th", "table", "caption"} - {tag} if tag in BLOCKS else BLOCKS
        if tag in ("table", "tr", "tbody", "thead", "tfoot"):
            borders = frozenset({"table"} - {tag})
        node = self.now
        while node is not self.root and node.tag != tag and node.tag not in borders:
            node = node.parent
        if node is not self.root and node.tag == tag:
            while self.now is not node:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        self.now.parts.append(data)


def walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Nodes that are not in chrome, before (True) and after (False) their parts; however deep the tree is."""
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, before = stack.pop()
        if node.chrome:
            continue
        yield node, before
        if before:
            stack.append((node, False))
            stack.extend((p, True) for p in reversed(node.parts) if isinstance(p, Node))


def spare_article(root: Node) -> None:
    """Where every article of a page lies in elements that are called like chrome, these aren't chrome."""
    inside, stack = [], [(root, False)]
    while stack:
        node, chrome = stack.pop()
        if node.chrome and not NO_ARTICLE.isdisjoint(node.names):
            continue
        chrome |= node.chrome
        if node.tag in ("article", "main") and not node.chrome:
            if not chrome:
                return
            inside.append(node)
        stack.extend((p, chrome) for p in node.parts if isinstance(p, Node) and p.tag not in CHROME)
    for node in inside:
        while node is not None:
            node.chrome = False
            node = node.parent


def measure(root: Node) -> list[Node]:
    """Lengths and link lengths of every node, in links by the nearest `a`; gives all nodes in page order."""
    nodes, links = [], 0
    for node, before in walk(root):
        if before:
            nodes.append(node)
            links += node.tag == "a"
            own = sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
            node.length, node.links = own, own if links else 0
        else:
            links -= node.tag == "a"
            if node.parent is not None:
                node.parent.length += node.length
                node.parent.links += node.links
    return nodes


def density(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def _has_blocks(node: Node) -> bool:
    return any(isinstance(p, Node) and not p.chrome and p.tag in BLOCKS and p.length for p in node.parts)


def _own_text(node: Node) -> str:
    """The text of a paragraph, without that of blocks in it."""
    out, stack = [], list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        elif not part.chrome and part.tag not in BLOCKS:
            stack.extend(reversed(part.parts))
    return " ".join("".join(out).split())


def score(nodes: list[Node]) -> Node | None:
    """Points of all containers; the best one."""
    scored: dict[int, Node] = {}
    for node in nodes:
        loose = node.tag in ("div", "section", "article", "main", "body", "html") and not _has_blocks(node)
        if node.tag not in PARAGRAPHS and not loose:
            continue
        text = _own_text(node)
        if not text:
            continue
        points = (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - density(node))
        up = node if loose else node.parent
        for level in range(LEVELS):
            if up is None:
                break
            up.points += points / (1, 2, 6, 9, 12)[level]
            scored[id(up)] = up
            up = up.parent
    best = None
    for node in scored.values():
        bonus = WORTH.get(node.tag, 0) + (5 if CONTENT_NAMES.intersection(node.names) and node.tag not in ("html", "body") else 0)
        node.points = (node.points + bonus) * (1 - density(node))
        if best is None or node.points > best.points:
            best = node
    return best


def kept_nodes(best: Node) -> list[Node | str]:
    """The article that the best container lies in, or else that container and its siblings that belong to it, in page order."""
    for tag in ("article", "main"):
        up = best
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None:
            return [up]
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least = max(1.0, best.points / 5)
    out: list[Node | str] = []
    for node in best.parent.parts:
        if isinstance(node, str):  # loose text between the containers
            if len(node) > 80 or SENTENCE.search(node):
                out.append(node)
            continue
        if node.chrome:
            continue
        prose = node.tag == "p" and density(node) < 0.25 and (node.length > 80 or (not node.links and SENTENCE.search(_own_text(node)) is not None))
        heading = node.tag == "h1" and node.length
        alike = node.tag == best.tag and node.names == best.names and node.length and density(node) < 0.25
        if node is best or prose or heading or alike or (node.points >= least and density(node) < 0.5 and node.tag not in WORTH_NOTHING):
            out.append(node)
    return out


WORTH_NOTHING = frozenset("ul ol dl li th a".split())  # as siblings of the best container these are lists of something else
BOXES = frozenset("ul ol dl div section table".split())


def blocks(nodes: list[Node | str]) -> list[str]:
    """One line for each block with text."""
    out: list[str] = []
    held: list[str] = []
    tops = {id(n) for n in nodes}

    def end() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            out.append(line)

    for top in nodes:
        stack: list[Node | str | None] = [None, top]
        while stack:
            part = stack.pop()
            if part is None:
                end()
            elif isinstance(part, str):
                held.append(part)
            elif part.tag == "br":
                held.append(" ")
            elif part.chrome or (id(part) not in tops and part.tag in BOXES and part.links > part.length / 2):
                continue
            elif part.tag in BLOCKS:
                end()
                stack.append(None)
                stack.extend(reversed(part.parts))
            else:
                stack.extend(reversed(part.parts))
    return out


def main_text(html: str) -> str:
    """The main text of one page."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    spare_article(tree.root)
    best = score(measure(tree.root))
    return "\n".join(blocks(kept_nodes(best))) if best is not None else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page.as_py()) if page.is_valid else "" for page in part.column(2)]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], names=["key", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars bigint").withColumnsRenamed({"key": key, "url": url})
