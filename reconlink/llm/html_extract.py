"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read to blocks of text (a block ends where a block element begins or ends). A small
linear classifier gives each block log odds of being content, from its length, link
density, tag and the elements around it; the costs of either label are its terminal
capacities. Neighbouring blocks, and neighbouring blocks of one parent, are joined by smoothness edges
that weaken with their distance in the DOM. A maximum flow separates the two labels.
Blocks whose own odds outweigh all their edges are settled beforehand, which changes no cut.

Scripts, styles, forms' fields and the like never become blocks. Inside a block, character
references are decoded and white space runs become one space; blocks are joined by
an empty line, in page order.

Cases: a null, empty or text-free page gives the empty text; cut-off pages and unclosed or
stray tags are read as far as they go; repeated pages are extracted each.
"""

from __future__ import annotations

import html
import re
from collections import deque
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import with_arrow_columns

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>?|</?[a-zA-Z][^>]*\Z""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PIECE = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text is no text of the page
SILENT = frozenset("script style noscript template head title textarea select option button svg math iframe object canvas audio video map datalist".split())
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")}
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: a new one of these ends an open one of the same group, unless one of the named elements lies between
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
}
ASIDE_TAGS = {"nav": "menu", "footer": "footer", "aside": "side", "form": "form", "dialog": "notice", "menu": "menu", "search": "form", "fieldset": "form"}
ROLES = {
    "navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alert": "notice",
    "alertdialog": "notice", "menu": "menu", "menubar": "menu", "toolbar": "menu", "tablist": "menu", "status": "notice",
}
#: parts of class and id names that mark boilerplate
ASIDE_WORDS = {
    w: kind
    for kind, words in {
        "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination paging toolbar topbar tabs toc skip skiplink sitemap",
        "footer": "footer foot colophon copyright legal imprint",
        "header": "masthead banner topnav siteheader",
        "side": "sidebar aside widget widgets related recommended recommendation recommendations similar trending popular share sharing social follow tags tagcloud author bio rail teaser outbrain taboola blogroll",
        "advert": "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion promoted dfp",
        "notice": "cookie cookies consent gdpr notice notices notification alert popup popover modal overlay toast newsletter subscribe subscription paywall disclaimer signup announcement",
        "comment": "comment comments commentlist disqus reply replies respond discussion feedback reviews",
        "form": "form login signin register search searchbox contact poll survey",
        "hidden": "hidden invisible screenreader sr offscreen",
    }.items()
    for w in words.split()
}
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article articlebody post entry story content main text body maintext prose markdown".split())
#: an element of such a name heads an article and not the page
HEADED = frozenset("article post entry story".split())
#: names that tell of a page's layout and not of a part of it, as in "has-sidebar"
LAYOUT = frozenset("has with no layout".split())
#: from these a content element inside leads back to content
SOFT = frozenset(("form", "header"))
LEGAL = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b|^\s*(?:advertisement|sponsored|anzeige|publicité|publicidad)\s*$", re.I)
ENDS = re.compile(r"""[.!?…:;]["'»”’)]*$""")


class Node:
    """An open element: its tag, number, parent and what it says about the text in it."""

    __slots__ = ("tag", "parent", "depth", "side", "good", "link", "silent")

    def __init__(self, tag: str, parent: Node | None, side: str, good: int, link: bool, silent: bool):
        self.tag, self.parent, self.side, self.good, self.link, self.silent = tag, parent, side, good, link, silent
        self.depth = parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("text", "linked", "chars", "node")

    def __init__(self, text: str, linked: int, chars: int, node: Node):
        self.text, self.linked, self.chars, self.node = text, linked, chars, node


def opened(tag: str, attributes: str, parent: Node) -> Node:
    """The node of a start tag."""
    side, good = parent.side, parent.good
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    names = {p.lower() for key in ("class", "id") if key in found for p in PIECE.findall(found[key])}
    kind = ASIDE_TAGS.get(tag) or ROLES.get(found.get("role", "").lower())
    if not kind and names and tag not in ("html", "body", "h1"):
        marks = [ASIDE_WORDS[n] for n in sorted(names) if n in ASIDE_WORDS]
        if names & LAYOUT:
            marks = [k for k in marks if k not in ("side", "hidden")]
        kind = marks[0] if marks else None
        if not kind and "header" in names and not names & HEADED:
            kind = "header"
    if tag == "header" and not kind and not good:
        kind = "header"
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        kind = "hidden"
    if kind and tag not in CONTENT_TAGS or kind == "comment":
        side = side or kind
        if kind not in SOFT:
            side = kind if side in SOFT else side
    elif tag in CONTENT_TAGS or found.get("itemprop", "").lower() == "articlebody" or found.get("role", "").lower() in ("main", "article"):
        good = 2
        side = "" if side in SOFT else side
    elif names & CONTENT_WORDS and tag in ("div", "section", "td"):
        good = max(good, 1)
    return Node(tag, parent, side, good, parent.link or tag == "a", parent.silent or tag in SILENT)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    node = Node("#page", None, "", 0, False, False)
    parts: list[str] = []
    linked = at = 0
    owner = node

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, len(text), owner))
            parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked, owner
        if raw and not node.silent:
            if not parts:
                owner = node
                while owner.parent and owner.tag not in BLOCKS:
                    owner = owner.parent
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if node.link:
                linked += len(" ".join(text.split()))

    def close(wanted: tuple[str, ...], until: tuple[str, ...]) -> None:
        """Leave the nearest open element of the wanted tags, if none of ``until`` lies between."""
        nonlocal node
        n = node
        while n.parent and n.tag not in wanted:
            if n.tag in until:
                return
            n = n.parent
        if n.parent:
            node = n.parent

    while True:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1] if m[2] else m[4]), (m[3] if m[2] else m[6]) or ""
        if closing:
            if tag in BLOCKS:
                flush()
            if tag not in VOID:
                close((tag,), ("article", "main", "section", "td", "body") if tag not in BLOCKS else ())
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            flush()
            if tag not in ("label", "legend"):
                close(("p",), ("article", "main", "section", "div", "td", "li", "body", "aside", "nav", "header", "footer", "form", "blockquote"))
            if tag in CLOSES:
                close(*CLOSES[tag])
        if tag not in VOID:
            made = opened(tag, attributes, node)
            if not attributes.rstrip().endswith("/") or tag in BLOCKS:
                node = made
    flush()
    return out


def odds(block: Block) -> float:
    """Log odds of a block being content."""
    words, node = block.text.count(" ") + 1, block.node
    score = 0.8 + 2.5 * min(words, 40) / 40 - 4.0 * min(1.0, block.linked / block.chars)
    score += (0.8 if ENDS.search(block.text) else 0.0) - (0.3 if words <= 3 else 0.0)
    score += {"h1": 1.5, "h2": 0.3, "h3": 0.3, "li": -0.6, "td": -0.4, "th": -0.4, "dt": -0.4, "address": -1.5, "label": -3.0, "legend": -3.0, "summary": -0.5}.get(node.tag, 0.0)
    score += (0.0, 2.0, 4.0)[node.good]
    if node.side:
        score -= 14.0
    if LEGAL.search(block.text):
        score -= 6.0
    return score


def apart(a: Node, b: Node) -> int:
    """Steps between two elements in the DOM."""
    steps = 0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a = a.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between neighbouring blocks, and between neighbouring children of one parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            # what a container marks as aside ends at its border
            same = bool(blocks[i - 1].node.side) == bool(block.node.side)
            out[i - 1, i] = (0.2 + 1.2 / (1 + apart(blocks[i - 1].node, block.node) / 2)) * (1.0 if same else 0.2)
        parent = id(block.node.parent)
        if parent in last and last[parent] != i - 1:
            out[last[parent], i] = 0.4
        last[parent] = i
    return out


def cut(own: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labels (content or not) of least total cost: terminal capacities against smoothness."""
    n = len(own)
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for (i, j), w in edges.items():
        around[i].append((j, w))
        around[j].append((i, w))
    label: list[bool | None] = [None] * n
    # settle what no neighbourhood can turn; a settled neighbour then counts like own odds
    pull, free = list(own), [sum(w for _, w in x) for x in around]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(pull[i]) > free[i]:
            label[i] = pull[i] > 0
            for j, w in around[i]:
                if label[j] is None:
                    free[j] -= w
                    pull[j] += w if label[i] else -w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        source, sink = len(rest), len(rest) + 1
        flow = Flow(len(rest) + 2)
        for i in rest:
            # costs -log(1 - p) of calling it boilerplate and -log(p) of calling it content
            flow.add(source, number[i], soft(pull[i]), 0.0)
            flow.add(number[i], sink, soft(-pull[i]), 0.0)
            for j, w in around[i]:
                if i < j and label[j] is None:
                    flow.add(number[i], number[j], w, w)
        inside = flow.run(source, sink)
        for i in rest:
            label[i] = inside[number[i]]
    return [bool(x) for x in label]


def soft(x: float) -> float:
    return x + log1p(exp(-x)) if x > 0 else log1p(exp(x))


class Flow:
    """Maximum flow by levels and blocking flows."""

    def __init__(self, size: int):
        self.out: list[list[int]] = [[] for _ in range(size)]
        self.to: list[int] = []
        self.left: list[float] = []

    def add(self, a: int, b: int, there: float, back: float) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [there, back]

    def levels(self, source: int) -> list[int]:
        level, queue = [-1] * len(self.out), deque([source])
        level[source] = 0
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.left[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> list[bool]:
        """Whether each node is on the source's side of the cut."""
        while (level := self.levels(source))[sink] >= 0:
            nxt, path, a = [0] * len(self.out), [], source
            while True:
                if a == sink:
                    most = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= most
                        self.left[e ^ 1] += most
                    full = next(k for k, e in enumerate(path) if self.left[e] <= 1e-9)
                    a, path = self.to[path[full] ^ 1], path[:full]
                    continue
                while nxt[a] < len(self.out[a]):
                    e = self.out[a][nxt[a]]
                    if self.left[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    nxt[a] += 1
                if nxt[a] < len(self.out[a]):
                    path.append(self.out[a][nxt[a]])
                    a = self.to[path[-1]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break
        return [x >= 0 for x in level]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    labels = cut([odds(b) for b in blocks], edges_of(blocks))
    return "\n\n".join(b.text for b, content in zip(blocks, labels) if content)


def extract(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text and its length in code points."""
    made = T.StructType([T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(texts: list[str]) -> list[pa.Array]:
        found = [main_text(t) for t in texts]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return with_arrow_columns(pages, page, made, lambda: work)
