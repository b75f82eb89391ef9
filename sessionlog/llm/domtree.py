"""HTML to a small block tree, and simple tree matching of two such trees."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field
from math import isqrt

import numpy as np

#: Elements nested deeper than this are taken as part of the element at this depth.
DEEPEST = 150
#: Child pairs up to which the whole table of two child lists is held; of larger ones some rows are, and the result is the same.
MOST_PAIRS = 1 << 20
#: Remembered scores and attribute texts.
REMEMBERED = 1 << 16

# Elements by the part they play in a page.
RAW = "script style textarea title xmp noembed noframes"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
    table tbody td tfoot th thead tr ul""".split())
DROPPED = set("""head script style noscript template iframe object embed svg math canvas audio video map form button
    select option textarea input fieldset dialog menu nav footer aside title""".split())
DROPPED_ROLES = set("""navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar
    toolbar tablist status""".split())
DROPPED_NAMES = set("""ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo
    promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe
    subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead topbar
    toolbar pagination pager share sharing social related recommended comment comments disqus respond reply
    replies""".split())
DROPPED_ARTICLES = set("ad ads advert advertisement comment comments promo related reply sponsored".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW.replace(" ", "|") + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|</?[a-zA-Z][^<>]*(?:>|(?=<)|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAMES = re.compile(r"[a-z]+", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Start tags that end an open element, and the elements beyond which they do not look for it.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th"), ("table",)), "tbody": (("tr", "td", "th", "thead"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody"), ("table",)),
}
_CELLS = {"td", "th", "caption", "table"}


@dataclass(slots=True, eq=False)
class Node:
    """An element, or a block of text (``text`` is not None)."""

    label: str
    kids: list = field(default_factory=list)
    text: str | None = None
    linked: int = 0  # characters within links
    dropped: bool = False  # by its element, role or name
    article: bool = False
    main: bool = False
    header: bool = False
    run: list = field(default_factory=list)
    shape: int = 0
    size: int = 1
    at: int = 0


class Attributes:
    """What the attributes of a start tag say, remembered by their text."""

    def __init__(self):
        self.known: dict[tuple[str, str], tuple[str, bool, bool, bool, bool]] = {}

    def of(self, tag: str, text: str) -> tuple[str, bool, bool, bool, bool]:
        """(label, dropped, article, main, header)."""
        key = (tag, text)
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = self._read(tag, text)
        return self.known[key]

    @staticmethod
    def _read(tag: str, text: str) -> tuple[str, bool, bool, bool, bool]:
        got = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(text)}
        names = set(_NAMES.findall(got.get("class", "") + " " + got.get("id", "")))
        role = got.get("role", "")
        article = tag == "article" or role == "article" or got.get("itemprop") == "articlebody"
        main = tag == "main" or role == "main"
        unseen = ("hidden" in got or got.get("aria-hidden") == "true" or bool(_HIDDEN.search(got.get("style", ""))))
        if tag in ("html", "body"):
            dropped = False
        elif article or main:
            dropped = unseen or bool(names & DROPPED_ARTICLES) and not main
        else:
            dropped = unseen or tag in DROPPED or role in DROPPED_ROLES or bool(names & DROPPED_NAMES)
        label = ".".join([tag, *sorted(got.get("class", "").split())])
        return label, dropped, article and not dropped, main, tag == "header" or "header" in names and tag != "body"


def parse(page: str, attributes: Attributes) -> Node:
    """The block tree of a page.

    Elements that can hold blocks are nodes; other markup is part of the text around it, but for
    such as is left out (buttons, hidden spans).  Text is decoded and its white space made
    single spaces.  End tags may be missing, markup may be cut off.
    """
    root = Node("html")
    stack, nodes, opened = ["html"], [root], {"html": 1}
    links = 0

    def flush(node):
        if node.run:
            raw = "".join(t for t, _ in node.run)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                node.kids.append(Node("#text", text=text, linked=sum(len(t) for t, a in node.run if a)))
            node.run = []

    def pop():
        opened[stack.pop()] -= 1
        flush(nodes.pop())

    def close(tags, stops):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i] in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i] in stops:
                return

    pos = 0
    for m in _TOKEN.finditer(page):
        if m.start() > pos:
            nodes[-1].run.append((page[pos:m.start()], links > 0))
        pos = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            if opened.get(tag):
                close((tag,), () if tag in _CELLS or tag not in BLOCK else _CELLS)
            continue
        if tag == "a":
            links = 1
        block = tag in BLOCK
        if tag == "br" or tag == "hr":
            if block:
                flush(nodes[-1])
            nodes[-1].run.append((" ", False))
            continue
        if tag in VOID or tag == "html" or (tag == "body" and opened.get("body")):
            continue
        if not block and tag not in DROPPED and not m[4]:
            continue
        label, dropped, article, main, header = attributes.of(tag, m[4])
        if not block and not dropped:
            continue
        if block:
            if opened.get("p"):
                close(("p",), _CELLS)
            if tag in _ENDS:
                close(*_ENDS[tag])
            if opened.get("head") and tag != "head":
                close(("head",), ())
            flush(nodes[-1])
        if m[4].endswith("/") and not block or len(stack) >= DEEPEST:
            continue
        node = Node(label, dropped=dropped, article=article, main=main, header=header)
        nodes[-1].kids.append(node)
        stack.append(tag)
        nodes.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    if pos < len(page):
        nodes[-1].run.append((page[pos:], links > 0))
    while nodes:
        flush(nodes.pop())
    return root


def leaves(node: Node) -> list[Node]:
    """Blocks of text in page order."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.text is not None:
            out.append(n)
        stack.extend(reversed(n.kids))
    return out


class Matcher:
    """Simple tree matching: the largest order-preserving top-down mapping of equal labels.

    Scores depend on the trees' shapes alone and are remembered by pairs of shapes.
    """

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.scores: dict[tuple[int, int], int] = {}

    def ready(self, tree: Node) -> Node:
        """Number the shapes and places of a tree's nodes; once per task that matches it."""
        order, stack = [], [tree]
        while stack:
            n = stack.pop()
            n.at = len(order)
            order.append(n)
            stack.extend(reversed(n.kids))
        for n in reversed(order):
            key = (n.label, tuple(k.shape for k in n.kids))
            n.shape = self.shapes.setdefault(key, len(self.shapes) + 1)
            n.size = 1 + sum(k.size for k in n.kids)
        return tree

    def full(self) -> bool:
        """Whether what is remembered should go; trees must be made ready again then."""
        return len(self.shapes) > REMEMBERED or len(self.scores) > 4 * REMEMBERED

    def score(self, a: Node, b: Node) -> int:
        """Number of matched pairs of nodes."""
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        if not a.kids or not b.kids:
            return 1
        key = (a.shape, b.shape)
        found = self.scores.get(key)
        if found is None:
            found = 1 + sum(s for _, _, s in self._pairs(a.kids, b.kids))
            if len(self.scores) > MOST_PAIRS:  # scores of one page may be many; they can be found again
                self.scores.clear()
            self.scores[key] = found
        return found

    def _pairs(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node, int]]:
        """The best pairing of two child lists, in order.

        Children of equal shape at both ends are paired first: no other partner can score more.
        """
        lo, a, b = 0, len(left), len(right)
        while lo < min(a, b) and left[lo].shape == right[lo].shape:
            lo += 1
        while a > lo and b > lo and left[a - 1].shape == right[b - 1].shape:
            a, b = a - 1, b - 1
        out = [(left[i], right[i], left[i].size) for i in range(lo)]
        out += [(left[a + i], right[b + i], left[a + i].size) for i in range(len(left) - a)]
        x, y = left[lo:a], right[lo:b]
        if not x or not y:
            return out
        if len(x) * len(y) > MOST_PAIRS:
            return out + self._long_pairs(x, y)
        best = [[0] * (len(y) + 1)]
        single = []
        for p in x:
            row, above, mine = [0], best[-1], []
            for j, q in enumerate(y):
                s = self.score(p, q)
                mine.append(s)
                row.append(max(above[j] + s if s else 0, above[j + 1], row[j]))
            best.append(row)
            single.append(mine)
        i, j = len(x), len(y)
        while i and j:
            here = best[i][j]
            if here == best[i - 1][j]:
                i -= 1
            elif here == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((x[i], y[j], single[i][j]))
        return out

    def _long_pairs(self, x: list[Node], y: list[Node]) -> list[tuple[Node, Node, int]]:
        """The pairs that the table of :meth:`_pairs` gives, with few of its rows held.

        The first pass keeps a row now and then; the way back makes the rows between two of them again.
        """
        shapes, place = np.unique([q.shape for q in y], return_inverse=True)
        of_shape = {q.shape: q for q in y}
        distinct, known = [of_shape[s] for s in shapes.tolist()], {}

        def scores(p):
            if p.shape not in known:
                if len(known) * len(y) > MOST_PAIRS:
                    known.clear()
                known[p.shape] = np.array([self.score(p, q) for q in distinct], np.int32)[place]
            return known[p.shape]

        def below(row, p):
            s, new = scores(p), row.copy()
            new[1:] = np.maximum(np.where(s > 0, row[:-1] + s, 0), row[1:])
            return np.maximum.accumulate(new)

        step, row, kept = isqrt(len(x)) + 1, np.zeros(len(y) + 1, np.int32), []
        for i, p in enumerate(x):
            if i % step == 0:
                kept.append(row)
            row = below(row, p)
        out, j = [], len(y)
        for lo in reversed(range(0, len(x), step)):
            rows = [kept.pop()]
            for p in x[lo:lo + step]:
                rows.append(below(rows[-1], p))
            i = len(rows) - 1
            while i and j:
                here = rows[i][j]
                if here == rows[i - 1][j]:
                    i -= 1
                elif here == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((x[lo + i], y[j], int(scores(x[lo + i])[j])))
        return out

    def align(self, tree: Node, other: Node) -> dict[int, int]:
        """Places in ``tree`` matched with places in ``other`` (both made ready)."""
        out = {}
        if tree.label != other.label:
            return out
        todo = [(tree, other)]
        while todo:
            a, b = todo.pop()
            out[a.at] = b.at
            todo.extend((p, q) for p, q, _ in self._pairs(a.kids, b.kids))
        return out
