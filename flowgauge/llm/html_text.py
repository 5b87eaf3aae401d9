"""Main text of web pages by composite text density.

Every node of the page's tree gets a composite density: its characters per tag, lowered where
characters stand in links and raised where tags are not links. The density sum of a node is the
sum over its children. The smallest density on the path from the body to the node with the largest
sum is the threshold. From the body downwards, every branch that reaches the threshold gives its
subtree with the largest sum to the main text; branches below it are left out. Within the chosen
subtrees, nodes that by their nature are not text are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import slices

#: Elements without content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements whose content is not markup.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math")
#: Elements that never hold main text.
NEVER = frozenset(
    "head script style noscript template iframe object svg math canvas form button select option "
    "textarea input label nav header footer aside menu dialog audio video".split()
)
#: Whole names of class, id or role that speak for boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar side widget comment comments disqus "
    "reply replies cookie cookies consent notice popup modal newsletter subscribe signup login "
    "share social related recommended pagination pager search contentinfo complementary toolbar "
    "copyright".split()
)
#: A so named subtree with at least this share of the page's text, and no article or main element
#: beside it, goes only if it is not dense.
LARGE_SHARE = 0.5
#: Elements inside a line of text; all others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, if it is still open.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Opening one of these closes an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th article section div main body html ul ol nav aside".split())

#: First parts of names (before a hyphen or underscore) that speak for readers' comments.
COMMENTS = frozenset("comment comments disqus reply replies".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Attributes up to the end of the tag; a > between quotes does not end it.
_INSIDE = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+")
_FIRST_PART = re.compile("[^-_]*").match
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "parent", "items", "skip", "named", "own", "chars", "tags", "link_chars",
                 "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: "Node | None", skip: bool, named: bool = False):
        self.tag, self.parent, self.skip, self.named = tag, parent, skip, named
        self.items: list["Node | str"] = []


def _judged(tag: str, attributes: str) -> tuple[bool, bool]:
    """Never main text; named like boilerplate."""
    if tag in NEVER:
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    named = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true":
            return True, False
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
        if name in ("class", "id", "role"):
            named = named or any(n in BOILERPLATE or _FIRST_PART(n)[0] in COMMENTS for n in value.split())
    return False, named


def tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, end tag, start tag, attributes) of comments, declarations and tags; names of the
    kind that it is not are empty. Each character is looked at a bounded number of times: a < that
    begins nothing, or that no > follows, is text. A tag with a quote that never closes ends at the
    next >."""
    at = 0
    while (less := html.find("<", at)) >= 0:
        mark = html[less + 1 : less + 2]
        if html.startswith("<!--", less):
            end = html.find("-->", less + 4)
            yield less, (at := end + 3 if end >= 0 else len(html)), "", "", ""
            continue
        name = _NAME.match(html, less + 2 if mark == "/" else less + 1)
        if name is None and mark not in ("!", "?"):
            at = less + 1
            continue
        close = html.find(">", name.end() if name else less + 2)
        if close < 0:
            # No tag ends from here on; a comment may still begin.
            at = html.find("<!--", less + 1)
            if at < 0:
                return
            continue
        if name is None or mark == "/":
            yield less, (at := close + 1), name[0] if name else "", "", ""
            continue
        inside = _INSIDE.match(html, name.end()).end()
        if html.startswith(">", inside):
            close = inside
        yield less, (at := close + 1), "", name[0], html[name.end() : close]


def parse(html: str) -> Node:
    """A forgiving tree of the page: unknown end tags are ignored, open elements are closed."""
    root = node = Node("#root", None, False)
    is_open: Counter[str] = Counter()
    at = 0

    def back_to(outer: Node) -> Node:
        up = node
        while up is not outer:
            is_open[up.tag] -= 1
            up = up.parent
        return outer

    for start, end, closing, opening, attributes in tokens(html):
        if start < at:
            continue  # inside of an element that is no markup
        if start > at:
            node.items.append(unescape(html[at:start]))
        at = end
        if closing:
            tag, up = closing.lower(), node
            if not is_open[tag]:
                continue
            while up is not root and up.tag != tag and not (up.tag in SCOPE and tag not in SCOPE):
                up = up.parent
            if up is not root and up.tag == tag:
                node = back_to(up.parent)
        elif opening:
            tag = opening.lower()
            node = back_to(_close_before(node, tag, root, is_open))
            child = Node(tag, node, *_judged(tag, attributes))
            node.items.append(child)
            if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
                continue
            if tag in RAW:
                found = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = found.end() if found else len(html)
                continue
            is_open[tag] += 1
            node = child
    if at < len(html):
        node.items.append(unescape(html[at:]))
    return root


def _close_before(node: Node, tag: str, root: Node, is_open: Counter[str]) -> Node:
    if tag in CLOSES_P and is_open["p"]:
        up = node
        while up is not root and up.tag not in SCOPE and up.tag != "p":
            up = up.parent
        if up.tag == "p":
            node = up.parent
    closed = CLOSED_BY.get(tag, ())
    if left := sum(is_open[c] for c in closed):
        up, outer = node, None
        while left and up.tag not in ("ul", "ol", "dl", "table", "select"):
            if up.tag in closed:
                outer, left = up, left - 1
            up = up.parent
        if outer is not None:
            node = outer.parent
    return node


def _in_order(root: Node) -> list[Node]:
    """Parents before children; what is skipped is left out with all below it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(i for i in node.items if i.__class__ is Node and not i.skip)
    return order


def _count(node: Node) -> None:
    chars = tags = link_chars = link_tags = own = text_chars = 0
    for item in node.items:
        if item.__class__ is str:
            text_chars += len(" ".join(item.split()))
        elif not item.skip:
            chars += item.chars
            tags += item.tags + 1
            link_chars += item.link_chars
            link_tags += item.link_tags + (item.tag == "a")
            if item.tag in INLINE and item.tag != "a":
                own += item.chars
    node.own, node.chars, node.tags = own + text_chars, chars + text_chars, tags
    node.link_chars, node.link_tags = link_chars, link_tags
    if node.tag == "a":
        node.link_chars, node.link_tags = node.chars, node.tags


def measure(order: list[Node], body: Node) -> None:
    """Composite text density of every node, and the sums over children."""
    for node in reversed(order):
        _count(node)
    body_share = body.link_chars / max(body.chars, 1)
    for node in order:
        node.density = _density(node, body_share)
    for node in order:
        node.total = node.own + sum(
            i.density for i in node.items
            if i.__class__ is Node and not i.skip and i.tag not in INLINE
        )


def _density(node: Node, body_share: float) -> float:
    """Characters per tag times a logarithm whose argument falls and whose base grows with the
    share of links (the composite text density)."""
    chars, links = node.chars, node.link_chars
    if not chars:
        return 0.0
    tags, link_tags = max(node.tags, 1), max(node.link_tags, 1)
    plain = max(chars - links, 1)
    base = math.log(chars / plain * links + body_share * chars + math.e)
    value = (chars / max(links, 1)) * (tags / link_tags)
    if base <= 0 or value <= 1:
        return 0.0
    return chars / tags * math.log(value) / base


def main_nodes(root: Node) -> list[Node]:
    """The subtrees of the main text in page order."""
    order = _in_order(root)
    body = next((n for n in order if n.tag == "body"), root)
    if named := [n for n in order if n.named]:
        for node in reversed(order):
            _count(node)
        marked = [n for n in order if n.tag in ("article", "main") and n.chars]
        around = [set(_path(n, root)) for n in marked]
        for node in named:
            own = _path(node, root)
            beside = any(node not in up and n not in own for n, up in zip(marked, around))
            node.skip = beside or node.chars < LARGE_SHARE * body.chars
        order = _in_order(root)
    measure(order, body)
    for node in reversed(order):
        node.best = None if node.tag in INLINE else node
        for item in node.items:
            if item.__class__ is Node and not item.skip and item.best is not None:
                if node.best is None or item.best.total >= node.best.total:
                    node.best = item.best
    if body.best is None:
        return []
    path = _path(body.best, body)
    least, least_plain = min(n.density for n in path), min(map(_plain, path))

    def dense(node: Node) -> bool:
        return node.density >= least or _plain(node) >= least_plain

    for node in order:
        if node.named and not dense(node):
            node.skip = True
    return _chosen(body, dense)


def _plain(node: Node) -> float:
    """Characters outside links per tag. The composite density grows with the size of a node; by
    this a short section of the same kind of text reaches the threshold too."""
    return (node.chars - node.link_chars) / max(node.tags, 1)


def _chosen(body: Node, dense: Callable[[Node], bool]) -> list[Node]:
    """Every branch that reaches the threshold gives its subtree with the largest sum, and so does
    each branch below it. Text that stands between branches is a branch of its own; headings go with
    what follows them."""
    body_share = body.link_chars / max(body.chars, 1)
    chosen, best, way, stack = [], set(), set(), [body]
    while stack:
        node = stack.pop()
        reaches = dense(node)
        if reaches and node.best is not None and node not in best:
            best.add(node.best)
            up = node.best
            while up not in way:
                way.add(up)
                up = up if up is node else up.parent
        if node in best or node.tag in HEADINGS or node.best is None:
            chosen.append(node)
            continue
        found, headings = [], []
        for branch in _branches(node, body_share):
            if branch in way or reaches and branch.chars and dense(branch):
                found += [*headings, branch]
                headings = []
            elif reaches and branch.tag in HEADINGS and 2 * branch.link_chars < branch.chars:
                headings.append(branch)
            elif branch.chars:
                headings = []
        stack.extend(reversed(found))
    return chosen


def _branches(node: Node, body_share: float) -> Iterator[Node]:
    """The blocks of a node; runs of text and inline elements without blocks are taken together."""
    run: list[Node | str] = []
    for item in [*node.items, None]:
        if item.__class__ is str or item is not None and (item.skip or item.best is None):
            run.append(item)
            continue
        if any(i.__class__ is Node or i.strip() for i in run):
            text = Node("#text", node, False)
            text.items, text.best = run, None
            _count(text)
            text.density = _density(text, body_share)
            yield text
        run = []
        if item is not None:
            yield item


def _path(node: Node, top: Node) -> list[Node]:
    path = [node]
    while node is not top and node.parent is not None:
        node = node.parent
        path.append(node)
    return path


def blocks(nodes: list[Node]) -> list[str]:
    """Text blocks in page order, white space as single spaces."""
    found: list[list[str]] = [[]]
    stack: list[Node | str | None] = nodes[::-1]
    while stack:
        item = stack.pop()
        if item is None:
            found.append([])
        elif isinstance(item, str):
            found[-1].append(item)
        elif not item.skip:
            inline = item.tag in INLINE
            if not inline:
                found.append([])
                stack.append(None)
            stack.extend(reversed(item.items))
    cleaned = (" ".join("".join(parts).split()) for parts in found if parts)
    return [text for text in cleaned if text]


def extract(html: str) -> list[str]:
    """The blocks of a page's main text; none if it has no text."""
    if not html:
        return []
    return blocks(main_nodes(parse(html)))


def extract_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: id, url, ``text`` (blocks joined by one space; empty if none) and
    ``n_blocks``.

    Null and empty pages have an empty text; null ids and URLs and repeated rows are kept; an
    empty table gives an empty result; other columns are not read. Whole pages are parsed, nothing
    is cut. The work is per row: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "html"):
            found = [extract(html or "") for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"),
                 pa.array([" ".join(f) for f in found], pa.string()),
                 pa.array([len(f) for f in found], pa.int32())],
                ["id", "url", "text", "n_blocks"],
            )

    read = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    kinds = [read.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = read.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_blocks int")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
