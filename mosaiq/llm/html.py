"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements without content, elements whose content isn't markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"p": BLOCK - {"option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"}}
# Fixed values of this extractor: what is never main text.
NEVER = frozenset("nav footer aside form button select menu dialog search head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Parts of class names and ids: always left out; left out unless most of the page is inside; what marks a name as a state; what marks it as content.
ALWAYS = re.compile(r"ads?|advert\w*|sponsor\w*|breadcrumbs?|cookies?|consent|gdpr|alerts?|pop-?up|modal|newsletter|subscribe\w*|signup|login|share\w*|sharing|social|related|recommend\w*|comment\w*|repl(?:y|ies)|respond|disqus")
LAYOUT = re.compile(r"banners?|promo\w*|nav\w*|menus?|topbar|header|masthead|footer|side-?bar|notices?")
STATE = frozenset("no has with without is not non hide show open opened closed free less enabled disabled active visible hidden layout".split())
CONTENT = frozenset("content article post entry story main body text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "up", "parts", "chars", "link_chars", "tags", "link_tags", "inline", "inline_links", "density", "total", "peak", "mark", "clean", "covered")

    def __init__(self, tag: str, up: Node | None, mark: str | None = None):
        self.tag, self.up, self.mark = tag, up, mark
        self.inline = self.inline_links = 0
        self.peak: Node = self
        self.parts: list[Node | tuple[str, bool]] = []
        self.chars = self.link_chars = self.tags = self.link_tags = self.clean = 0
        self.density = self.total = 0.0


def _named(value: str) -> str | None:
    """What a class or an id says of its element: no main text, part of the page's layout, or nothing.

    Each name is judged by its parts. ``no-sidebar`` or ``nav-open`` are states of a wrapper, and
    ``entry-header`` belongs to the content. Beside ``content`` or ``post``, layout names say nothing, and of the
    others only whole names: ``post category-social`` is a post of a category, ``post comments`` are comments.
    """
    said = None
    names = value.lower().split()
    content = any(name in CONTENT for name in names)
    for name in names:
        parts = re.split(r"[-_]+", name)
        if not STATE.isdisjoint(parts):
            continue
        parts.append(re.sub(r"[-_]+", "", name))
        if any(map(ALWAYS.fullmatch, parts if not content else parts[-1:])):
            return "always"
        found = {p for p in parts if LAYOUT.fullmatch(p)}
        if found and not content and not (found == {"header"} and not CONTENT.isdisjoint(parts)):
            said = "layout"
    return said


def _left_out(tag: str, attrs: str, article: bool) -> str | None:
    """What tag and attributes say: ``gone`` if it isn't seen at all, ``always`` or ``layout`` if it isn't main text unless the page is in it."""
    if tag in ("head", "button", "select"):
        return "gone"
    if tag in NEVER or tag == "header" and not article:
        return "always"
    if not attrs or tag in ("html", "body", "article", "main"):
        return None
    said = None
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return "gone"
        if name == "role" and value.lower() in ROLES:
            said = "always"
        if name in ("class", "id"):
            said = "always" if said == "always" else _named(value) or said
    if said and tag not in BLOCK:
        # Inside a sentence only an advert is no part of it.
        return "gone" if re.search(r"(?:^|[\s\"'=_-])(?:ads?|advert\w*|sponsor\w*)(?:$|[\s\"'_-])", attrs, re.I) else None
    return said


def parse(html: str) -> Node:
    """The tree of blocks, with text and link text in order; what is never main text isn't in it.

    Inline elements are part of the block around them and count as tags of it.
    """
    root = Node("html", None)
    now, links, skip, articles = root, 0, [], 0
    at, n = 0, len(html)
    open_: list[str] = []  # of what is left out

    def text(s: str) -> None:
        if s and not open_:
            now.parts.append((s, links > 0))

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing, attrs = m[2].lower(), m[1] == "/", m[3] or ""
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = end.start() if end else n
            if end:
                close = html.find(">", at)
                at = close + 1 if close >= 0 else n
            continue
        if open_:
            if closing:
                if tag in open_:
                    del open_[len(open_) - 1 - open_[::-1].index(tag) :]
                elif open_[0] == "head" and tag == "html":
                    open_.clear()
                continue
            if not (open_[-1] == "head" and tag == "body" or tag == "body"):
                if tag not in VOID and not attrs.rstrip().endswith("/"):
                    open_.append(tag)
                continue
            open_.clear()
        if tag == "br" or tag not in BLOCK:
            if tag in ("br", "img", "wbr"):
                text(" " if tag == "br" else "")
            elif tag == "a":
                links = max(0, links + (-1 if closing else 1))
                now.inline += not closing
                now.inline_links += not closing
            elif not closing and tag not in VOID:
                if _left_out(tag, attrs, articles > 0):
                    open_.append(tag)
                else:
                    now.inline += 1
            continue
        if closing:
            x = now
            while x is not None and x.tag != tag:
                x = x.up
            if x is not None and x.up is not None:
                now, links = x.up, 0
                articles -= tag in ("article", "main") and articles > 0
            elif tag == "p":
                now.parts.append(Node("p", now))
            continue
        if tag in ("html", "body"):
            if tag == "body" and now is root:
                now = Node("body", root)
                root.parts.append(now)
            continue
        x = now
        while x.up is not None and x.tag in CLOSED_BY:
            if tag in CLOSED_BY[x.tag]:
                now = x.up
            x = x.up
        said = _left_out(tag, attrs, articles > 0)
        if said == "gone":
            if tag not in VOID:
                open_.append(tag)
            continue
        links = 0
        node = Node(tag, now, said)
        now.parts.append(node)
        if tag not in VOID:
            now = node
            articles += tag in ("article", "main")
    return _pruned(root)


def _measure(root: Node) -> list[Node]:
    """All nodes, parents first, with their counts."""
    order = [root]
    for x in order:
        order += [p for p in x.parts if isinstance(p, Node)]
    for x in reversed(order):
        x.chars, x.link_chars, x.tags, x.link_tags = 0, 0, x.inline, x.inline_links
        for p in x.parts:
            if isinstance(p, Node):
                x.chars += p.chars
                x.link_chars += p.link_chars
                x.tags += p.tags + 1
                x.link_tags += p.link_tags
            else:
                k = len("".join(p[0].split()))
                x.chars += k
                x.link_chars += k * p[1]
    return order


def _pruned(root: Node) -> Node:
    """The tree without the nodes that their tags or names mark, but for those that the page's text is in.

    A layout name goes unless more than half of the text is inside. Other marks (menus, forms, adverts,
    comments) go, too, unless that is so and what no mark covers is less than a tenth of it, with no article
    outside: a form around the whole page, an advert that is never closed, a post with a category in its names. Of a
    node that stays, what is marked inside is judged in the same way, by the text of that node.
    """
    _measure(root)

    def cleaned() -> list[Node]:
        order = [root]
        root.covered = False
        for x in order:
            for p in x.parts:
                if isinstance(p, Node):
                    p.covered = x.covered or x.mark is not None
                    order.append(p)
        for x in reversed(order):
            inside = [p for p in x.parts if isinstance(p, Node)]
            x.clean = x.chars - sum(p.chars for p in inside) + sum(p.clean for p in inside if not p.mark)
        return order

    page = root
    while True:
        order = cleaned()
        outer = [x for x in order if x.mark and not x.covered]
        article = any(x.clean and x.tag in ("article", "main") and not x.covered for x in order)
        within = [x for x in outer if x.chars * 2 > page.chars and (x.mark == "layout" or 10 * root.clean < x.chars and not article)]
        if not within:
            break
        page = within[0]
        own = sum(len("".join(p[0].split())) for p in page.parts if not isinstance(p, Node))
        if page.mark == "always" and own * 2 < page.chars:
            page.parts = [p for p in page.parts if isinstance(p, Node)]  # what stands loose in an advert or a form
        page.mark = None
        _measure(root)
    for x in outer:
        x.up.parts = [p for p in x.up.parts if p is not x]
    return root


def main_node(root: Node) -> tuple[Node | None, float]:
    """The node with the largest sum of its children's composite densities, and the least density on its path to the body.

    A node's composite density is its characters per tag, times a logarithm that falls as links make up
    more of its characters and tags; the logarithm's base grows with the node's link text and with the
    page's share of it, and is 2 at least (nearer to 1 it would rate short nodes above all others).
    Direct text counts as a child. The outermost of equal sums wins.
    """
    order = _measure(root)
    share = (root.link_chars + 1) / (root.chars + 1)
    for x in order:
        if x.chars:
            tags, link_chars, link_tags = x.tags or 1, x.link_chars or 1, x.link_tags or 1
            base = math.log(x.chars / max(1, x.chars - x.link_chars) * x.link_chars + share * x.chars + math.e)
            ratio = max(x.chars / link_chars * tags / link_tags, 1.0)
            x.density = x.chars / tags * math.log(ratio + math.e - 1) / math.log(max(2.0, base))
    best = None
    for x in reversed(order):
        own = sum(len("".join(p[0].split())) for p in x.parts if not isinstance(p, Node))
        x.total = sum(p.density for p in x.parts if isinstance(p, Node)) + (x.density if own * 2 > x.chars else 0)
        x.peak = x
        for p in x.parts:
            if isinstance(p, Node) and p.peak.total > x.peak.total * (1 + 1e-9):
                x.peak = p.peak
    best = root.peak if root.chars else None
    least, x = best.density if best else math.inf, best
    while x is not None and x.tag != "html":
        least, x = min(least, x.density), x.up
    return best, least


def _selected(top: Node, least: float) -> list[Node]:
    """The subtree of the largest sum in each node that is as dense as the threshold, outermost ones in page order."""
    chosen, order, stack = set(), [], [top]
    while stack:
        x = stack.pop()
        if x.chars and x.density >= least:
            chosen.add(id(x.peak))
        stack += [p for p in x.parts if isinstance(p, Node)]
    stack = [top]
    while stack:
        x = stack.pop()
        if id(x) in chosen:
            order.append(x)
        else:
            stack += [p for p in reversed(x.parts) if isinstance(p, Node)]
    return order


def _blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            plain = _WHITE.sub(" ", unescape("".join(run))).strip()
            if plain:
                out.append(plain)
            run.clear()

    stack = [iter(node.parts)]
    while stack:
        for p in stack[-1]:
            if isinstance(p, Node):
                flush()
                stack.append(iter(p.parts))
                break
            run.append(p[0])
        else:
            flush()
            stack.pop()
    return out


def main_text(html: str) -> str:
    """The main text of a page: its blocks in page order, one a line; empty if there is none.

    The node of ``main_node`` gives the text; an ancestor takes its place while what the ancestor adds
    is a heading or is as dense as the threshold, the least density on the path to the body. An article
    that holds the node is whole, and then the page's text is in it; without one, the subtrees of the
    largest sum in all nodes that are as dense as the threshold belong to it too.
    """
    if not html:
        return ""
    root = parse(html)
    best, least = main_node(root)
    if best is None:
        return ""
    x, up, article = best, best.up, best.tag in ("article", "main")
    while up is not None and up.tag != "html":
        others = [p for p in up.parts if isinstance(p, Node) and p is not x and p.chars]
        article = article or up.tag in ("article", "main")
        if up.tag in ("article", "main") or others and all(p.tag in ("h1", "h2", "h3", "hgroup", "header") or p.density >= least for p in others):
            best = up
        x, up = up, up.up
    if article:
        return "\n".join(_blocks(best))
    best.peak = best
    x = best.up
    while x is not None:  # what was widened stays whole
        x.peak, x = best, x.up
    return "\n".join(line for node in _selected(root, least) for line in _blocks(node))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``; a null page is empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py() or "") for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
