"""Main text of web pages by composite text density over the DOM (operator 5)."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
#: Containers that are dropped, like marked ones, unless they hold the page's text: some servers put whole pages in one form.
OPTIONAL = frozenset(("form",))
#: Elements that never hold article text.
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas button select option textarea input nav aside footer dialog menu title audio video map".split())
#: Elements that an article consists of.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre ul ol dl table figure details section li dt dd".split())
#: Words of class, id and role that mark what surrounds an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside widget footer masthead cookie cookies consent notice notices notification alert popup modal newsletter subscribe signup login share sharing social related recommended "
    "comment comments commentlist disqus respond replies pagination pager toolbar skip contentinfo complementary search".split()
)
#: Start tags that end an open paragraph, and those that end a sibling of their own kind.
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": (), "tfoot": ("tbody", "thead", "tr", "td", "th")}
#: Elements that an end tag or an implied end doesn't reach out of.
SCOPES = frozenset("table ul ol dl body html article section main div".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAMES = re.compile(r"[^\s\"']+")
_PIECES = re.compile("[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.items, self.dropped, self.doubtful = tag, parent, [], dropped, False
        self.chars = self.link_chars = self.link_tags = 0
        self.tags, self.density, self.total = 1, 0.0, 0.0


def _marked(tag: str, attributes: str) -> bool:
    """Whether all pieces of some name in class, id or role are marks, as in cookie-banner or ad-1 but not in with-sidebar."""
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    names = (_PIECES.findall(name) for m in _ATTRIBUTE.finditer(attributes) for name in _NAMES.findall(m.group(1).lower()))
    return any(pieces and MARKS.issuperset(pieces) for pieces in names)


def parse(page: str) -> Node:
    """The body of a page as a tree; unclosed and stray tags are mended, comments and declarations dropped."""
    body = Node("body", None)
    node, at, n = body, 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            node.items.append(page[at:])
            break
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            up = node
            while up is not body and up.tag != tag:
                if up.tag in SCOPES and tag not in SCOPES:
                    up = body
                    break
                up = up.parent
            if up is not body:
                node = up.parent
            continue
        if tag in ("html", "body", "head"):
            if tag == "head":
                node = _open(node, "head", True)
            elif tag == "body":
                node = body
            continue
        if node.tag == "head" and tag in BLOCKS:
            node = body
        if tag in ENDS_P:
            node = _implied_end(node, ("p",))
        if tag in ENDS_OWN:
            node = _implied_end(node, ENDS_OWN[tag], own=True)
        attributes = m.group(3) or ""
        inside_article = tag == "header" and _within(node, ("article", "main"))
        child = _open(node, tag, tag in DROPPED or tag == "header" and not inside_article)
        child.doubtful = tag in OPTIONAL or _marked(tag, attributes)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            at = n if close is None else page.find(">", close.start()) + 1 or n
            child.dropped = True
            continue
        node = child
    _drop_doubtful(body)
    return body


def _drop_doubtful(body: Node) -> None:
    """Drops marked nodes and forms, but for those that hold most of the page's text outside links.

    Such a node goes too if an article or main with text is outside all of them: then it is a long list of comments or so.
    """
    order, stack = [], [(body, False)]
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        stack += [(x, link or node.tag == "a") for x in node.items if isinstance(x, Node) and not x.dropped]
    free: dict[Node, int] = {}
    for node, link in reversed(order):
        link = link or node.tag == "a"
        free[node] = sum(free.get(x, 0) if isinstance(x, Node) else 0 if link else len("".join(x.split())) for x in node.items)
    named = any(node.tag in ("article", "main") and free[node] and not _doubted(node) for node, _ in order)
    for node, _ in order:
        if node.doubtful:
            node.dropped = named or 2 * free[node] <= free[body]


def _doubted(node: Node | None) -> bool:
    while node is not None:
        if node.doubtful:
            return True
        node = node.parent
    return False


def _open(node: Node, tag: str, dropped: bool) -> Node:
    child = Node(tag, node, dropped)
    node.items.append(child)
    return child


def _within(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _implied_end(node: Node, tags: tuple[str, ...], own: bool = False) -> Node:
    up = node
    while up is not None:
        if up.tag in tags:
            return up.parent
        if up.tag in SCOPES and (not own or up.tag in ("table", "ul", "ol", "dl", "body")):
            return node
        up = up.parent
    return node


def measure(body: Node) -> None:
    """Characters, tags, link characters and link tags of every subtree, its composite density and the sum of its children's.

    The density is characters per tag, adjusted by how much of the text and of the tags are links, with the body's own
    share of link text in the base of the logarithm; e - 1 is added to that base, which is 1 on a page without links. A
    run of text right inside a node counts as a child of its own.
    """
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node) and not x.dropped]
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.dropped:
                node.chars += x.chars
                node.tags += x.tags
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        c, lc = node.chars, node.link_chars
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / node.tags * math.log(c / max(1, lc) * node.tags / max(1, node.link_tags)) / math.log(base + math.e - 1)
        node.density = max(node.density, 0.0)
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.dropped)
        node.total += sum(len(t) for x in node.items if isinstance(x, str) and (t := "".join(x.split())))


def _linked(node: Node) -> bool:
    """Whether most of a subtree's text is links."""
    return 2 * node.link_chars > node.chars


def _has_content(node: Node) -> bool:
    """Whether a subtree has paragraphs, headings, lists or the like and isn't mostly links."""
    if not node.chars or _linked(node):
        return False
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag in CONTENT or x.tag == "article":
            return True
        stack += [y for y in x.items if isinstance(y, Node) and not y.dropped]
    return False


def _container(best: Node) -> Node:
    """The subtree that the article fills: the article or else the main around the densest one, else the nearest with more content.

    More content is text or a subtree with content beside the one that leads to the densest. The body isn't lifted to.
    """
    near, main, came, node = None, None, best, best
    while node is not None and node.parent is not None:
        if node.tag == "article":
            return node
        if node.tag == "main":
            main = main or node
        if near is None and node is not best and any(x.strip() if isinstance(x, str) else x is not came and not x.dropped and _has_content(x) for x in node.items):
            near = node
        came, node = node, node.parent
    return main or near or best


def content(body: Node) -> list[Node]:
    """The subtrees that hold the article: the container of the one with the largest sum of densities, and others off the path.

    The threshold is the smallest density on the path from the container to the body. A subtree off the path counts if it
    reaches the threshold. Articles, and if the container is no article or main also paragraphs, headings, lists and the like
    right beside the path, count unless they are mostly links.
    """
    best, stack = body, [body]
    while stack:
        node = stack.pop()
        if node.total > best.total:
            best = node
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.dropped]
    if best is body:
        return [body]
    best = _container(best)
    # inside one block of prose there is nothing to choose
    while best.parent is not None and (best.tag not in BLOCKS or best.tag in CONTENT - {"section"}) and best.parent.chars and best.parent is not body:
        best = best.parent
    path, node = set(), best
    while node is not None:
        path.add(node)
        node = node.parent
    threshold = min(x.density for x in path if x is not best)
    beside = {"article"} if best.tag in ("article", "main") else CONTENT | {"article"}
    out: list[Node] = []

    def walk(node: Node) -> None:
        for x in node.items:
            if not isinstance(x, Node) or x.dropped or not x.chars:
                continue
            if x is best:
                out.append(x)
            elif x in path:
                walk(x)
            elif x.tag in beside and not _linked(x) or x.density >= threshold and x.tag in BLOCKS:
                out.append(x)

    walk(body)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks of subtrees in page order: references decoded, white space one space, trimmed, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(text)
            held.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                held.append(x)
            elif not x.dropped:
                block = x.tag in BLOCKS
                if block:
                    end()
                    stack.append(None)
                stack += reversed(x.items)
        end()
    return out


def extract(page: str | None) -> str:
    """The main text of one page; empty for a null page or one without any."""
    if not page:
        return ""
    body = parse(page)
    measure(body)
    return "\n".join(blocks(content(body)))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html, ...).

    A null or empty page has the empty text; rows with null or repeated ids keep their own row; other columns are
    ignored; an empty table gives an empty result. Whole pages are read; nothing of the article is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
