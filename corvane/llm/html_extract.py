"""Main-text extraction from HTML by tree scoring.

A page is cut once into tags and text. Text collects in blocks; each block
keeps the element that holds it. A block gives points (one, one for every comma,
up to three for its length), discounted by the share of its characters that
stand in links, to its parent in full, to its grandparent by half, and to the
next ancestors by a third, a quarter and so on, eight in all. The element with
the most points, discounted by its own link density, is the best container. If
it lies in an <article> or <main>, that is taken whole, and so is each further
ancestor with few links and no furniture among its children. Beside it, headings,
paragraphs, lists, quotes and tables are kept, and siblings that score well. Menus,
page headers, footers, sidebars, notices, adverts, forms and reader comments
give no points and are never kept.

What an element is called counts as furniture only if every part of a name does
("sidebar", "left-sidebar", "cookie-notice"), so that "has-sidebar",
"no-comments" or "page-header-fixed" on a wrapper say nothing. And a name yields
to the content: an element called furniture that holds the only article, main or
first heading of the page, or nine tenths of a page without any, is read after all.
All steps are linear in the page.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text of the page.
SKIPPED = "script style noscript template textarea select svg math iframe object canvas audio video title button".split()
#: Elements that are never part of an article.
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
#: Elements that end the block before them and after them.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes an open element of these kinds, looking no further up than the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
}
#: Words in class, id or role that mark what surrounds an article.
UNLIKELY = set(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored sponsors banner promo promos promotion popup modal overlay cookie cookies consent gdpr notice "
    "notices alert alerts sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead header footer foot "
    "copyright legal disclaimer share sharing social follow subscribe subscription newsletter signup login register search related recommended recommendations comment comments "
    "commentlist disqus respond reply replies discussion feedback hidden complementary contentinfo".split()
)
#: Words that say nothing about an element beside one of the words above.
NEUTRAL = set(
    "a the and top bottom left right upper lower first last box area section wrapper wrap container block inner outer list item items bar panel pane region group row col column "
    "site page main global primary secondary body content text form link links button buttons post posts story stories article articles user reader readers id js".split()
)
#: Words in class or id that mark an article.
LIKELY = set("article body content entry hentry main page post story text blog".split())
WEIGHT = {"article": 25.0, "main": 20.0}

#: Elements that are text of the article when they stand beside it.
PROSE = set("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl blockquote pre table figure details".split())

_SKIP = "|".join(SKIPPED)
_INSIDE = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_SKIP})\b{_INSIDE}(?:(?<=/)>|>(?:.*?</(?P=raw)\s*>|.*\Z))"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_INSIDE})>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_RAW_END = re.compile(rf"(?i)(?:</(?:{_SKIP})\s*|/)>\Z")
_ATTR = re.compile(r"""(?i)\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


#: Points go to so many ancestors.
LEVELS = 8


class _Node:
    __slots__ = ("anchors", "chars", "down", "items", "link", "mixed", "named", "off", "parent", "score", "shut", "tag", "within")

    def __init__(self, tag: str, parent: _Node | None, off: bool, named: bool, base: float) -> None:
        self.tag, self.parent, self.score = tag, parent, base
        self.shut = off  # furniture whatever it holds, by itself or by an ancestor
        self.named = named  # furniture by its name
        self.off = off
        self.chars = self.link = self.items = self.anchors = 0
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        self.mixed = self.down = False


def _furniture(value: str) -> bool:
    """Whether one of the names in a class, id or role has only parts that mark furniture, or say nothing beside one that does."""
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if any(p in UNLIKELY for p in parts) and all(p in UNLIKELY or p in NEUTRAL for p in parts):
            return True
    return False


def _kind(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, float]:
    """Whether an element is page furniture by what it is, or by its name, and its points to begin with."""
    off, named, base = tag in CHROME or (tag == "header" and not in_article), False, WEIGHT.get(tag, 0.0)
    if "=" in attrs or "hidden" in attrs.lower():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value)):
                off = True
            elif name in ("class", "id", "role") and tag not in ("body", "html", "main", "h1"):
                named |= _furniture(value)
                base += 5.0 * any(p.lower() in LIKELY for n in value.split() for p in _PARTS.findall(n))
    return off, named, base


class _Open:
    """The open elements, with the places of each kind, so that no end tag has to look for its start."""

    def __init__(self, root: _Node) -> None:
        self.stack, self.places = [root], {}

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: set[str], bounds: set[str]) -> None:
        """Close the nearest open element of ``tags``, unless one of ``bounds`` is nearer."""
        at = self.last(tags)
        if at and at >= self.last(bounds):
            while len(self.stack) > at:
                self.places[self.stack.pop().tag].pop()


def _tree(page: str) -> tuple[list[_Node], list[tuple[str, int, _Node]]]:
    """Elements (parents before children), and blocks of text in page order with the characters in links and the element that holds them."""
    root = _Node("#root", None, False, False, 0.0)
    nodes, out, elements = [root], [], _Open(root)
    stack = elements.stack
    parts: list[str] = []
    linked: list[str] = []
    in_link, at = False, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                k = min(len(text), len(" ".join(_html.unescape("".join(linked)).split()))) if linked else 0
                out.append((text, k, stack[-1]))
            parts, linked = [], []

    def text(s: str) -> None:
        if s:
            parts.append(s)
            if in_link:
                linked.append(s)

    # Behind the last ">" no tag ends; what begins there is text, or an open comment.
    last = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, last):
        text(page[at : m.start()])
        at = m.end()
        if at == last and (m[0].startswith("<!--") and not m[0].endswith("-->") or m["raw"] and not _RAW_END.search(m[0])):
            at = len(page)  # never closed
        tag, end, attrs = m["tag"] or m["tag2"], m["end"] or m["end2"], m["attrs"] or ""
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text(" ")
        elif tag == "a":
            in_link = not end
        elif tag in BLOCKS:
            flush()
            in_link = False
            if end:
                elements.close({tag}, set())
                continue
            if stack[-1].tag == "p":
                elements.close({"p"}, set())
            if tag in CLOSES:
                elements.close(*CLOSES[tag])
            if tag == "hr" or attrs.endswith("/"):
                continue
            parent = stack[-1]
            off, named, base = _kind(tag, attrs, parent.within or parent.tag in ("article", "main"))
            node = _Node(tag, parent, parent.shut or off, named, base)
            nodes.append(node)
            elements.push(node)
            parent.items += tag == "li"
    tail = page[at:]
    text(tail[: tail.find("<!--")] if "<!--" in tail else tail)
    flush()
    return nodes, out


def _judged(nodes: list[_Node], found: list[tuple[str, int, _Node]]) -> None:
    """Settle which elements are furniture, and pass points, characters and links up."""
    for text, k, node in found:
        node.chars += len(text)
        node.link += k
    for n in reversed(nodes[1:]):  # children come before their parents here
        n.anchors += n.tag in ("article", "main", "h1") and not n.shut
        n.parent.chars += n.chars
        n.parent.link += n.link
        n.parent.anchors += n.anchors
    shut = sum(n.chars for n in nodes[1:] if n.shut and not n.parent.shut)
    outside = nodes[0].anchors - sum(n.anchors for n in nodes[1:] if n.named and not _under_name(n))
    for n in nodes[1:]:
        if n.named and not n.shut and not n.parent.off and outside <= 0:
            if n.anchors or (not nodes[0].anchors and 10 * n.chars >= 9 * (nodes[0].chars - shut)):
                n.named = False
        n.off = n.shut or n.named or n.parent.off
    for text, k, node in found:
        points, up, share, level = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - k / len(text)), node, 0, 0
        while up is not None and level < LEVELS and not node.off:
            if up.tag != "p":
                share += 1
                up.score += points / share
            up, level = up.parent, level + 1
    for n in nodes[1:]:
        n.down = n.parent.down or (n.items >= 3 and n.link * 3 > n.chars * 2)  # in a list of links


def _under_name(n: _Node) -> bool:
    """Whether an element lies in another that is furniture by name; told by a mark that is passed down in order."""
    n.mixed = n.parent.mixed or n.parent.named
    return n.mixed


def extract(page: str | None) -> str:
    """The article of a page: its blocks, joined by blank lines. Empty if there is none.

    Broken markup, missing end tags and unclosed comments are read as far as
    they make sense; a text without any tag is one block.
    """
    nodes, found = _tree(page or "")
    for n in nodes[1:]:
        _under_name(n)
    _judged(nodes, found)
    blocks = [(t, n) for t, _, n in found if not n.off and not n.down]
    if not blocks:
        return ""

    def worth(n: _Node) -> float:
        return n.score * (1 - n.link / max(n.chars, 1))

    def dense(n: _Node) -> float:
        return n.link / max(n.chars, 1)

    held: set[int] = set()  # elements with a block that can be kept
    for _, n in blocks:
        while n is not None and id(n) not in held:
            held.add(id(n))
            n = n.parent
    for n in nodes:
        n.mixed = False
    for n in nodes[1:]:  # elements with furniture among their children
        if n.chars and ((n.off and not n.parent.off) or (n.tag not in PROSE - {"ul", "ol"} and dense(n) >= 0.33)):
            n.parent.mixed = True
    best = max((n for n in nodes if id(n) in held and (n.tag != "p" or n.parent is None)), key=worth, default=nodes[0])
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    for tag in ("main", "article"):
        best = next((n for n in reversed(above) if n.tag == tag), best)
    while best.parent is not None and not best.parent.mixed and dense(best.parent) < 0.25:
        best = best.parent
    keep = {id(best)}
    if best.parent is not None and best.tag not in ("body", "html"):
        for n in nodes:
            if n.parent is best.parent and n is not best and id(n) in held and dense(n) < 0.33:
                if n.tag in PROSE or (n.tag == best.tag and worth(n) >= max(10.0, 0.2 * worth(best))):
                    keep.add(id(n))
    for n in nodes[1:]:
        if id(n.parent) in keep:
            keep.add(id(n))
    return "\n\n".join(t for t, n in blocks if id(n) in keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    A null or empty html gives an empty text and 0; null ids and urls pass
    through; repeated rows each give a row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
