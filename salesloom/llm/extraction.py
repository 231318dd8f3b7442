"""Main text of web pages by tag-path ratios.

A page is read once into blocks: text of one element that starts a new line, with the
path of tags from the root to it. Per path the length of the text outside links and
its punctuation are added up and divided by the number of blocks. Both ratios are
smoothed over similar paths, weighted by the part of the path that they share: paths
form a tree, and sums for each of its nodes give all smoothed values in one walk. The
ratios are multiplied, and paths at or above ``SHARE`` of the standard deviation are
content. The content node is the smallest container of the blocks on these paths; its
other blocks (headings, short paragraphs, lists) belong to the text, too.

Navigation, page headers and footers, asides, forms, scripts, styles and elements with
such a role are no candidates. A class or id that names an advert, menu, notice, comments
and the like is a hint: text in it counts ``HINTED`` of its length, and is left out
unless the content node itself lies in it. Time and memory are in proportion to the page,
also where tags do not end, every block has a path of its own, or elements nest deeply.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined by a line break. Defined results: null, empty and blank pages give
an empty text, and so do pages without a block that could be content. Broken and cut
pages are read as far as they go. Repeated rows and null ids are answered row by row.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm import arrays

SHARE = 0.5
HINTED = 0.02

RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video"
# Attributes up to the tag's end. Signs are taken once and for good, and an open quote
# aside nothing reaches past the next tag.
ATTRIBUTES = r"""(?:[^'"<>]|"[^"]*"|'[^']*')*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{ATTRIBUTES}(?:(?<=/)>|>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z))"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[\s/]{ATTRIBUTES})?)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*+(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var".split()
)
CONTAINERS = frozenset("html body main article section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that a start tag of the given kind closes, within the given bound.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PUNCTUATION = re.compile(r"[.,;:!?。,、!?…]")

OTHER_TAGS = frozenset("nav footer aside form button dialog menu head fieldset".split())
OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split()
)
# Words that name something beside the article in a class or id.
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion "
    "promoted banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "comment comments discussion disqus respond reply replies cookie cookies consent gdpr notice "
    "notification notifications alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations widget widgets toolbar pagination "
    "pager search".split()
)


def _beside(tag: str, names: dict[str, str], in_article: bool) -> bool:
    """Whether an element is none of the article by its tag or role."""
    if tag in OTHER_TAGS or (tag == "header" and not in_article):
        return True
    return names.get("role", "").lower() in OTHER_ROLES


def _hinted(tag: str, names: dict[str, str], in_article: bool) -> bool:
    """Whether class or id name something beside the article."""
    if tag in ("html", "body", "main", "article"):
        return False
    for word in re.split(r"\s+", f"{names.get('class', '')} {names.get('id', '')}".lower()):
        parts = re.split(r"[-_]+", word)
        if word in OTHER_WORDS or parts[0] in OTHER_WORDS:
            return True
        if parts[0] == "header" and not in_article:
            return True
        if len(parts) > 1 and parts[-1] in OTHER_WORDS and parts[0] not in ("has", "with", "no"):
            return True
    return False


class Paths:
    """Paths of block tags as a tree: each node has a parent, and a number above it."""

    def __init__(self):
        self.parent, self.depth = [-1], [0]
        self.known: dict[tuple[int, str], int] = {}

    def step(self, path: int, name: str) -> int:
        found = self.known.setdefault((path, name), len(self.parent))
        if found == len(self.parent):
            self.parent.append(path)
            self.depth.append(self.depth[path] + 1)
        return found


class _Node:
    """An open element: tag, path of block tags to it, whether it may hold content.

    ``hint`` is the number of the closest element around it that is hinted at, or -1.
    """

    __slots__ = ("article", "block", "hint", "link", "number", "parent", "path", "skip", "tag")

    def __init__(self, tag, path, skip, link, article, number, parent, hint):
        self.tag, self.path, self.skip, self.link = tag, path, skip, link
        self.article, self.number, self.parent, self.hint = article, number, parent, hint
        self.block = self


class Page:
    """Blocks of a page in order: node, text, and characters outside links, without spaces.

    Nodes are numbered in the order of their start, so those within a node follow it.
    """

    def __init__(self, source: str):
        self.paths = Paths()
        self.nodes: list[_Node] = [_Node("", 0, False, False, False, 0, -1, -1)]
        self.stack = [self.nodes[0]]
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[_Node, str, int]] = []
        self.text: list[str] = []
        self.linked = 0
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._put(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["close"]:
                self._end(tag)
            else:
                self._start(tag, m["rest"] or "")
        self._put(source[at:])
        self._flush()

    def _put(self, piece: str) -> None:
        top = self.stack[-1]
        if not top.skip:
            self.text.append(piece)
            if top.link:
                self.linked += len("".join(piece.split()))

    def _flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                own = len(text) - text.count(" ") - self.linked
                self.blocks.append((self.stack[-1].block, text, max(0, own)))
        self.text, self.linked = [], 0

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._put(" ")
            return
        inline = tag in INLINE
        if not inline:
            self._flush()
            if tag in CLOSED_BY:
                self._close(*CLOSED_BY[tag])
            self._close({"p", *(HEADINGS if tag in HEADINGS else ())}, CONTAINERS | {"li", "blockquote"})
        if tag in VOID:
            return
        top = self.stack[-1]
        names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(rest)} if rest else {}
        skip = top.skip or _beside(tag, names, top.article)
        hinted = bool(names) and _hinted(tag, names, top.article)
        link, article = top.link or tag == "a", top.article or tag in ("article", "main")
        if inline:
            node = _Node(tag, top.path, skip or hinted, link, article, top.number, top.number, top.hint)
            node.block = top.block
        else:
            classes = names.get("class", "").split()
            path = self.paths.step(top.path, f"{tag}.{classes[0]}" if classes else tag)
            number = len(self.nodes)
            hint = number if hinted else top.hint
            node = _Node(tag, path, skip, link, article, number, top.number, hint)
            self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] += 1

    def _cut(self, i: int) -> None:
        for node in self.stack[i:]:
            self.open[node.tag] -= 1
        del self.stack[i:]

    def _close(self, tags: set[str], bound: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._cut(i)
                return
            if self.stack[i].tag in bound:
                return

    def _end(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._put(" ")
            return
        if tag not in INLINE:
            self._flush()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return
            if tag in INLINE and self.stack[i].tag not in INLINE:
                return

    def ends(self) -> np.ndarray:
        """Number of the last node within each node."""
        last = list(range(len(self.nodes)))
        for node in reversed(self.nodes[1:]):
            last[node.parent] = max(last[node.parent], last[node.number])
        return np.array(last)


def path_scores(paths: Paths, blocks: list[tuple[int, float, float]]) -> dict[int, float]:
    """Fused ratio of each path from (path, characters, punctuation) of its blocks.

    A path of depth d ends at a place of its own at d + 1. Two paths that share s steps
    count for each other with (s / (d + 1)) ** 4. All paths below a node share its depth
    at least, so what shares exactly a node's depth is its sum without that of the child
    on the way.
    """
    sums: dict[int, np.ndarray] = {}
    for path, chars, signs in blocks:
        own = sums.setdefault(path, np.zeros(3))
        own += (chars, signs, 1)
    ratios = np.zeros((len(paths.parent), 3))  # ratios of a path, and that it is one
    for path, own in sums.items():
        ratios[path] = (own[0] / own[2], own[1] / own[2], 1)
    below = ratios.copy()
    for path in range(len(below) - 1, 0, -1):
        below[paths.parent[path]] += below[path]
    depth = np.array(paths.depth, dtype=np.float64)
    above = np.zeros_like(below)  # what paths that part from this one further up add
    for path in range(1, len(below)):
        up = paths.parent[path]
        above[path] = above[up] + depth[up] ** 4 * (below[up] - below[path])
    scores = {}
    for path in sums:
        own = above[path] + depth[path] ** 4 * (below[path] - ratios[path]) + (depth[path] + 1) ** 4 * ratios[path]
        scores[path] = float(own[0] / own[2] * (1 + own[1] / own[2]))
    return scores


def main_text(source: str | None, share: float = SHARE) -> str:
    """Article text of a page: its blocks, joined by line breaks."""
    if not source:
        return ""
    page = Page(source)
    blocks = page.blocks
    if not blocks:
        return ""
    weights = [HINTED if n.hint >= 0 else 1.0 for n, _, _ in blocks]
    scores = path_scores(
        page.paths,
        [
            (n.path, w * own, w * len(PUNCTUATION.findall(t)))
            for w, (n, t, own) in zip(weights, blocks, strict=True)
        ],
    )
    values = np.array(list(scores.values()))
    bound = min(share * values.std(), values.max())
    best = [n for n, _, _ in blocks if scores[n.path] >= bound]
    # A path may hold blocks with and without a hint.
    chosen = [n for n in best if n.hint < 0] or best
    inside, base, last = _container(page, chosen)
    # What is hinted at belongs to the text only where it holds the content itself.
    return "\n".join(
        t
        for n, t, _ in blocks
        if inside <= n.number <= last[inside] and (n.hint < 0 or n.hint <= base <= last[n.hint])
    )


def _container(page: Page, chosen: list[_Node]) -> tuple[int, int, np.ndarray]:
    """The content node, the smallest container of the chosen nodes, and the ends of all.

    The content node is the article around that container if there is one, and else its
    parent while that adds headings only.
    """
    last = page.ends()
    numbers = [n.number for n in chosen]
    low, high = min(numbers), max(numbers)
    shared, at = [], low
    while at >= 0:
        node = page.nodes[at]
        if last[at] >= high and (node.tag in CONTAINERS or at == 0):
            shared.append(at)
        at = node.parent
    marked = [x for x in shared if page.nodes[x].tag in ("article", "main")]
    if marked:
        return marked[0], shared[0], last
    plain = np.zeros(len(page.nodes) + 1, dtype=np.int64)
    for node, _, _ in page.blocks:
        plain[node.number + 1] += node.tag not in HEADINGS
    plain = np.cumsum(plain)
    inside = shared[0]
    for above in shared[1:]:
        if plain[last[above] + 1] - plain[above] > plain[last[inside] + 1] - plain[inside]:
            break
        inside = above
    return inside, shared[0], last


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", share: float = SHARE
) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars (code points). No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.sliced(batch, "html"):
                texts = [main_text(x, share) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html")
    )
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(work, f"{kinds}, text string, n_chars long")
