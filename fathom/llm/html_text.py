"""Main text of web pages by tree scoring.

A page becomes a light tree of its block elements. Elements that cannot hold the article (menus, headers, footers,
asides, forms, scripts, styles, and those whose class, id or role says advert, sidebar, notice, comments and the like) are
left out. Every paragraph, a run of text in one block, has points: one, one for each comma, and one for each hundred
characters up to three. They pass to its container whole, to the container above by half, to the next three by a sixth,
a ninth and a twelfth, and a container's points are cut by its link density. The container of a paragraph is the element
above it; a div or section of LONG characters without blocks inside is a paragraph, too. The best container and those of its siblings that
score well, or read like prose, are the text. All of this takes time in proportion to the page, however deep it nests.

Character references are decoded. White space in a block becomes one space, blocks are trimmed and joined by one space.
Null, empty or text-free pages give an empty text. Broken markup (unclosed or stray tags, cut pages) is read as far as
it goes. Pages are read whole. Repeated rows are read one by one; other columns may have any names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import ship

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "xmp", "noembed"}
_DROP = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "label", "input", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rb", "rt", "rp", "nobr", "center",
}
_KEEP = {"html", "body", "article", "main"}
#: Words of class names, ids and roles that mark what is not the article.
NOISE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "form", "gdpr", "header", "hidden", "login", "masthead", "menu", "menubar",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion",
    "recommended", "recommendations", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "tags", "toolbar", "widget", "widgets",
}
#: An opening tag that ends an open one of these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PROSE = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
_ITEM = set().union(*_CLOSES.values()) | set(_CLOSES)
_LIST = {"ul", "ol", "dl", "table", "tbody", "thead", "select"}
LONG = 80
#: Shares of a paragraph's points that its container and those above it get.
_SHARES = (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12)


class _Node:
    __slots__ = ("name", "parent", "dropped", "score", "chars", "linked", "kids", "para", "item", "chosen")

    def __init__(self, name: str, parent: _Node | None, dropped: bool):
        self.name, self.parent, self.dropped = name, parent, dropped or (parent is not None and parent.dropped)
        self.score, self.chars, self.linked, self.chosen = 0.0, 0, 0, False
        self.kids: list[_Node] = []
        #: the nearest paragraph, and the nearest list item or table cell of the same list, from here upward
        self.para = self if name == "p" else parent and parent.para
        self.item = self if name in _ITEM else None if name in _LIST else parent and parent.item
        if parent is not None:
            parent.kids.append(self)

    def container(self, size: int) -> _Node:
        """Where the points of a paragraph of this size go first: loose text stands in its container itself."""
        paragraph = self.name in _PROSE or self.name in ("div", "section") and not self.kids and size >= LONG
        return self.parent if paragraph and self.parent is not None else self


def _noise(name: str, attrs: str) -> bool:
    if name in _DROP:
        return True
    if name in _KEEP or "=" not in attrs and "hidden" not in attrs:
        return False
    for k, a, b, c in _ATTR.findall(attrs):
        k, v = k.lower(), (a or b or c).lower()
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
            return True
        if k in ("class", "id", "role"):
            for one in v.split():
                words = _NAME.findall(one)
                if not {"has", "with", "no", "without"} & set(words[:-1]) and NOISE & set(words):
                    return True
    return False


def _parse(page: str) -> tuple[list[_Node], list[tuple[str, int, _Node]]]:
    """All elements in page order, the root first, and the text blocks in page order: text, characters of it in links, element."""
    root = _Node("#root", None, False)
    nodes, opened = [root], {}
    node, links, at = root, 0, 0
    blocks: list[tuple[str, int, _Node]] = []
    run: list[str] = []
    linked = 0

    def text(raw: str, decode: bool = True) -> None:
        nonlocal linked
        if raw and not node.dropped:
            s = html.unescape(raw) if decode and "&" in raw else raw
            run.append(s)
            if links:
                linked += len(s)

    def flush() -> None:
        nonlocal linked
        if run:
            s = _SPACE.sub(" ", "".join(run)).strip()
            if s:
                blocks.append((s, min(linked, len(s)), node))
            run.clear()
            linked = 0

    def leave(upto: _Node) -> None:
        """Closes the open elements below upto."""
        nonlocal node
        while node is not upto:
            opened[node.name] -= 1
            node = node.parent

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"], False)
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif name not in _INLINE:
                if opened.get(name):
                    flush()
                    while node.name != name:
                        leave(node.parent)
                    leave(node.parent)
                    links = 0
                elif name in ("p", "br"):
                    flush()
            continue
        if name in _RAW:
            if not m["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "a":
            links += 1
            continue
        if name in _INLINE:
            if _noise(name, m["attrs"]):
                # an inline element that is noise: a node of its own, closed by its end tag only
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else at
            continue
        flush()
        if name in _VOID:
            continue
        if (ends := _CLOSES.get(name)) is not None:
            while (up := node.item) is not None:
                while up is not None and up.name not in ends:
                    up = up.parent.item
                if up is None:
                    break
                leave(up.parent)
        # a paragraph ends where the next block begins
        if node.para is not None:
            leave(node.para.parent)
        links = 0
        node = _Node(name, node, _noise(name, m["attrs"]))
        nodes.append(node)
        opened[name] = opened.get(name, 0) + 1
        if m["attrs"].rstrip().endswith("/") and name not in ("p", "div", "article", "section"):
            leave(node.parent)
    flush()
    return nodes, blocks


def points(text: str, linked: int) -> float:
    """Points of a paragraph of which linked characters stand in links."""
    n = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) // 100, 3)
    return n * (1 - linked / len(text))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, blocks = _parse(page)
    if not blocks:
        return ""
    for s, linked, node in blocks:
        own, up = points(s, linked), node.container(len(s))
        for share in _SHARES:
            up.score += own * share
            if (up := up.parent) is None:
                break
        node.chars += len(s)
        node.linked += linked
    for x in reversed(nodes[1:]):
        x.parent.chars += x.chars
        x.parent.linked += x.linked

    def final(x: _Node) -> float:
        return x.score * (1 - x.linked / x.chars) if x.chars else 0.0

    best, most = nodes[0], -1.0
    for x in nodes:
        if not x.dropped and x.chars and (f := final(x)) > most:
            best, most = x, f
    # a list, table or quotation inside prose is not the article by itself
    while best.parent is not None and best.name in ("ul", "ol", "dl", "table", "tbody", "thead", "tr", "td", "li", "blockquote", "p", "pre"):
        best = best.parent
    up = best.parent
    while up is not None and up.name in ("article", "main") and not up.dropped:
        best, up = up, up.parent
    best.chosen, beside = True, None
    if best.parent is not None and best.name not in ("article", "main", "body"):
        least = max(10.0, 0.2 * most)
        for x in best.parent.kids:
            density = x.linked / x.chars if x.chars else 1.0
            if x.name in _PROSE and x.chars and density < 0.25 or final(x) >= least and density < 0.25:
                x.chosen = True
        # loose text beside the container
        beside = best.parent
    for x in nodes[1:]:
        x.chosen = x.chosen or x.parent.chosen
    return " ".join(s for s, _, node in blocks if node.chosen or node is beside)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text) for each row."""
    ship(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], names=[id, url, "text"])

    return pages.select(F.col(id), F.col(url), F.col(page).cast("string").alias("h")).mapInArrow(run, f"`{id}` {kinds[0]}, `{url}` {kinds[1]}, text string")
