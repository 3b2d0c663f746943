"""Main text of web pages by composite text density.

Each page becomes a small tree of arrays. For every node the link-adjusted
characters per tag are computed over its subtree; a node's density sum adds those
of its children. The node with the largest sum, and what else of the page
reaches the smallest density on that node's path up to the body, is the content,
with the rest of the article or main element it is in.
Elements that are never content (menus, forms, adverts, comments of readers, ...)
are taken out before densities are computed. Pages are independent, so the only
stage is a scan; a task holds one slice of pages at a time.
"""

from __future__ import annotations

import html as entities
import itertools
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import text_slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | {"p", "blockquote", "pre"}
NEVER = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe object embed svg canvas menu dialog "
    "audio video map noembed noframes xmp input".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words in class or id names that mark boilerplate, and words that take the mark back.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promoted promotion recommended related replies respond reviews share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
UNMARKS = frozenset("with has no without main content body article post entry page wrapper container story text".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Tree:
    """Nodes in page order as parallel lists, and events: (node, text) or (node, None) where the node is left."""

    def __init__(self) -> None:
        self.tag, self.parent, self.dead, self.start, self.stop = [], [], [], [], []
        self.events: list[tuple[int, str | None]] = []

    def open(self, tag: str, parent: int, dead: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.dead.append(dead)
        self.start.append(len(self.events))
        self.stop.append(-1)
        return len(self.tag) - 1

    def close(self, node: int) -> None:
        self.events.append((node, None))
        self.stop[node] = len(self.events)


def _marked(names: str) -> set[str]:
    """Boilerplate words in a class or id value."""
    found: set[str] = set()
    for name in names.split():
        parts = {p.lower() for p in NAME_PART.findall(name)}
        if not parts & UNMARKS:
            found |= parts & MARKS
            if "header" in parts:
                found.add("header")
    return found


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is never content; names do not mark a block of text inside an article or main element."""
    if tag in NEVER:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or values.get("role", "").lower() in ROLES:
        return True
    if inside and tag in TEXTS:
        return False
    marks = _marked(values.get("class", "")) | _marked(values.get("id", ""))
    return bool(marks & {"comment", "comments", "commentlist", "replies", "disqus"} if tag == "article" else marks)


class Stack:
    """The open elements of a page, with the depths at which each tag is open, so that nothing is searched level by level."""

    def __init__(self, tree: Tree) -> None:
        self.tree = tree
        self.nodes = [tree.open("html", -1, False)]
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # depths of block elements

    def push(self, tag: str, dead: bool) -> None:
        self.depths[tag].append(len(self.nodes))
        if tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(self.tree.open(tag, self.nodes[-1], dead))

    def leave(self, depth: int) -> None:
        """Close all elements from this depth on."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            tag = self.tree.tag[node]
            if self.nodes:
                self.depths[tag].pop()
                if tag in BLOCKS:
                    self.blocks.pop()
            self.tree.close(node)

    def deepest(self, tags: Iterable[str]) -> int:
        """The depth of the innermost open element of these tags; 0 without one."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close_tag(self, tag: str) -> None:
        """Leave the innermost element of the tag; an inline one cannot reach beyond the block it is in."""
        depth = self.deepest((tag,))
        if depth and (tag in BLOCKS or not self.blocks or self.blocks[-1] < depth):
            self.leave(depth)

    def make_room(self, tag: str) -> None:
        """Leave what a new block element closes: like items up to their list, or the paragraph around it."""
        if tag in CLOSES:
            closing, scope = CLOSES[tag]
            around = self.deepest(scope - closing - {"p"})
            found = [depths[k] for t in {*closing, "p"} if (depths := self.depths.get(t)) and (k := bisect_right(depths, around)) < len(depths)]
            if found:
                self.leave(min(found))
            return
        depth = self.deepest(("p",))
        if depth and depth >= max(self.deepest(("td", "th", "table", "button")), self.blocks[-1]):
            self.leave(depth)


def parse(page: str) -> Tree:
    """Tolerant parse: unclosed and misnested tags are closed the way browsers do for paragraphs, items and cells."""
    tree = Tree()
    stack = Stack(tree)
    at = 0
    while (token := TOKEN.search(page, at)) is not None:
        if token.start() > at:
            tree.events.append((stack.nodes[-1], page[at : token.start()]))
        at = token.end()
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["close"] or token["close2"]:
            stack.close_tag(tag)
            continue
        if tag == "br":
            tree.events.append((stack.nodes[-1], " "))
        if tag in VOID or tag == "html":
            continue
        if tag == "body" and stack.deepest(("body",)):
            continue
        if tag in BLOCKS:
            stack.make_room(tag)
        attrs = token["attrs"] if token["tag"] else token["attrs2"]
        if attrs.endswith("/") and tag in ("svg", "path", "use"):
            continue
        inside = tag in TEXTS and stack.deepest(("article", "main")) > 0
        stack.push(tag, _boilerplate(tag, attrs, inside))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
    if at < len(page):
        tree.events.append((stack.nodes[-1], page[at:]))
    stack.leave(0)
    return tree


def _live(tree: Tree) -> list[bool]:
    """Nodes outside boilerplate. What holds an article or main element is not boilerplate as a whole."""
    n = len(tree.tag)
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        if holds[i] or tree.tag[i] == "main" or (tree.tag[i] == "article" and not tree.dead[i]):
            holds[tree.parent[i]] = True
    live = [True] * n
    inside = [False] * n
    headings = headings_before(tree)
    for i in range(1, n):
        up = tree.parent[i]
        inside[i] = inside[up] or tree.tag[i] in ("article", "main")
        banner = tree.tag[i] == "header" and not (inside[i] and headings[tree.stop[i]] > headings[tree.start[i]])
        live[i] = live[up] and (holds[i] or not (tree.dead[i] or banner))
    return live


def headings_before(tree: Tree) -> list[int]:
    """For each event, how many of headings come before it."""
    return [0, *itertools.accumulate(tree.tag[k] in HEADINGS for k, _ in tree.events)]


def densities(tree: Tree, live: list[bool]) -> tuple[list[float], list[float], list[int]]:
    """Composite text density, density sum and characters of each live node; 0 elsewhere."""
    n = len(tree.tag)
    chars, links, tags, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.events:
        if text is not None and live[node]:
            own[node] += len("".join(text.split()))
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.parent[i]] or tree.tag[i] == "a"
    for i in range(n - 1, -1, -1):
        chars[i] += own[i]
        links[i] += own[i] if linked[i] else 0
        if i and live[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + linked[i]
    ratio = links[0] / max(1, chars[0])
    density, total = [0.0] * n, [float(c) for c in own]
    for i in range(n - 1, -1, -1):
        if live[i] and chars[i]:
            c, lc, t, lt = chars[i], max(1, links[i]), max(1, tags[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - links[i]) * lc + ratio * c + math.e)
            density[i] = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base)
            if i:
                total[tree.parent[i]] += density[i]
    return density, total, chars


def content_nodes(tree: Tree, live: list[bool]) -> list[int]:
    """Roots of the content: all that pass the threshold, widened to the article or main element around them.

    A root outside those elements gives way to the ones inside it that pass, if they hold at least half of its text.
    """
    density, total, chars = densities(tree, live)
    n = len(tree.tag)
    if not chars[0]:
        return []
    best = list(range(n))  # the largest density sum in each subtree
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if live[i] and (total[best[i]], -best[i]) > (total[best[up]], -best[up]):
            best[up] = best[i]
    top, path = best[0], []
    node = top
    while node >= 0:
        path.append(node)
        node = tree.parent[node]
    threshold = min(density[i] for i in path if tree.tag[i] != "html" or len(path) == 1)
    passing = [i for i in range(n) if live[i] and chars[i] and density[i] >= threshold]
    roots: set[int] = set()
    # around each node the outermost article, and the nearest main element
    article, main = [-1] * n, [-1] * n
    for i in range(n):
        up = tree.parent[i]
        article[i] = article[up] if i and article[up] >= 0 else i if tree.tag[i] == "article" else -1
        main[i] = i if tree.tag[i] == "main" else main[up] if i else -1
    holders = [i for i in passing if tree.tag[i] in ("article", "main")]
    for root in {best[i] for i in passing}:
        if max(article[root], main[root]) >= 0:
            roots.add(article[root] if article[root] >= 0 else main[root])
            continue
        inner, reached = [], 0
        for i in holders:
            if tree.start[root] <= tree.start[i] < tree.stop[root] and tree.start[i] >= reached:
                inner.append(i)
                reached = tree.stop[i]
        roots |= set(inner) if inner and 2 * sum(chars[i] for i in inner) >= chars[root] else {root}
    return sorted(roots)


def main_text(page: str | None) -> str:
    """Main text of a page: blocks in page order, joined by two newlines; empty for null, empty or contentless pages."""
    if not page:
        return ""
    tree = parse(page)
    live = _live(tree)
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        if block := " ".join("".join(words).split()):
            blocks.append(block)
        words.clear()

    block_of = list(range(len(tree.tag)))  # the nearest block element around each node
    for i in range(1, len(block_of)):
        if tree.tag[i] not in BLOCKS:
            block_of[i] = block_of[tree.parent[i]]
    reached = 0
    for root in content_nodes(tree, live):
        if tree.start[root] < reached:
            continue  # inside a root before
        reached = tree.stop[root]
        flush()
        last_block = root
        for node, text in tree.events[tree.start[root] : tree.stop[root]]:
            if text is None:
                if tree.tag[node] in BLOCKS:
                    flush()
                continue
            if not live[node]:
                continue
            block = max(block_of[node], root)  # parents come first, so a smaller number is outside the root
            if block != last_block:  # a block was entered
                flush()
                last_block = block
            words.append(entities.unescape(text))
        flush()
    return "\n\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, pages in text_slices(batches, "html"):
        texts = pa.array([main_text(p.decode("utf-8", "replace")) for p in pages], pa.string())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["page_id", "url", "text"])


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text.

    Character references are decoded; white space inside a block becomes one space.
    A null or empty html gives an empty text. Repeated rows, null ids and null urls
    pass through; other columns are ignored; an empty table gives no rows.
    """
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    return given.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
